"""Which files are artifacts, and how they will be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, lower

#: Fixed values, in the order in which they are tried: how the file's name is matched,
#: type, ecosystem, parser, whether the parser reads it in part. Names are lower case
#: unless exact.
RULES: tuple[tuple[str, str, str, str, str, bool], ...] = (
    ("dist-info", "", "Python installed distribution metadata", "PyPI", "python-dist-info-metadata", False),
    ("installed", "package.json", "installed package.json", "npm", "installed-package-json", False),
    ("name", "package.json", "package.json", "npm", "package-json", False),
    ("name", "package-lock.json", "package-lock.json", "npm", "package-lock-json", False),
    ("like", r"^requirements.*\.txt\z", "requirements.txt", "PyPI", "requirements-text", False),
    ("name", "pyproject.toml", "pyproject.toml", "PyPI", "conservative-pyproject-toml", True),
    ("name", "poetry.lock", "poetry.lock", "PyPI", "conservative-poetry-lock", True),
    ("name", "pipfile", "Pipfile", "PyPI", "unsupported-toml", False),
    ("name", "pipfile.lock", "Pipfile.lock", "PyPI", "pipfile-lock-json", True),
    ("like", r"^environment\.ya?ml\z", "environment.yml", "Conda", "conservative-conda-yaml", True),
    ("name", "go.mod", "go.mod", "Go", "go-mod-text", False),
    ("name", "go.sum", "go.sum", "Go", "conservative-go-sum", True),
    ("name", "cargo.toml", "Cargo.toml", "Cargo", "conservative-cargo-toml", True),
    ("name", "cargo.lock", "Cargo.lock", "Cargo", "conservative-cargo-lock", True),
    ("name", "pom.xml", "pom.xml", "Maven", "maven-pom-xml", False),
    ("like", r"^build\.gradle(\.kts)?\z", "Gradle build file", "Gradle", "unsupported-gradle", False),
    ("gradle-lock", "", "Gradle lock file", "Gradle", "conservative-gradle-lock", True),
    ("like", r"\.csproj\z", "MSBuild project", "NuGet", "msbuild-package-reference", False),
    ("name", "packages.lock.json", "packages.lock.json", "NuGet", "nuget-lock-json", False),
    ("name", "directory.packages.props", "Directory.Packages.props", "NuGet", "msbuild-central-package-xml", False),
    ("name", "composer.json", "composer.json", "Composer", "composer-json", False),
    ("name", "composer.lock", "composer.lock", "Composer", "composer-lock-json", False),
    ("name", "gemfile", "Gemfile", "RubyGems", "unsupported-ruby", False),
    ("name", "gemfile.lock", "Gemfile.lock", "RubyGems", "conservative-gemfile-lock", True),
    ("name", "vcpkg.json", "vcpkg.json", "vcpkg", "conservative-vcpkg-json", True),
    ("name", "conanfile.txt", "conanfile.txt", "Conan", "conservative-conan-text", True),
    ("name", "package.resolved", "Package.resolved", "Swift", "conservative-swift-resolved-json", True),
    ("name", "podfile.lock", "Podfile.lock", "CocoaPods", "conservative-podfile-lock", True),
    ("name", "yarn.lock", "yarn.lock", "npm", "conservative-yarn-lock", True),
    ("like", r"^pnpm-lock\.ya?ml\z", "pnpm-lock.yaml", "npm", "conservative-pnpm-lock", True),
    ("like", r"\.lp[ik]\z", "Lazarus project/package", "FreePascal", "lazarus-project-xml", False),
    ("like", r"^(license|copying|notice)(\..*)?\z", "license evidence", "", "license-evidence", False),
)
#: Most bytes that each sort of parser reads; others read 8 MiB, and files
#: that nothing parses have no limit.
MIB = 1 << 20
LIMITS = {
    2 * MIB: ("installed-package-json", "python-dist-info-metadata"),
    32 * MIB: ("package-lock-json", "pipfile-lock-json", "nuget-lock-json", "composer-lock-json", "conservative-swift-resolved-json"),
    64 * MIB: (
        "conservative-go-sum", "conservative-cargo-lock", "conservative-poetry-lock", "conservative-yarn-lock",
        "conservative-pnpm-lock", "conservative-gradle-lock", "conservative-gemfile-lock", "conservative-podfile-lock",
    ),
    0: ("unsupported-toml", "unsupported-gradle", "unsupported-ruby", "license-evidence"),
}


def classify(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """Adds artifact_type, ecosystem, parser and partial by the first rule that matches;
    they are null for files that are no artifacts. Names come first as columns, exact
    ones are found in one map, and the least number of a matching rule picks the row, so
    that nothing is evaluated twice and the stage compiles."""
    slashed, low = F.translate(path, "\\", "/"), F.col("_low")
    named = files.withColumns({"_name": base_name(F.col(path))}).withColumn("_low", lower(F.col("_name")))
    exact = {what: n for n, (how, what, *_) in reversed(list(enumerate(RULES))) if how == "name"}
    numbers = [F.element_at(F.create_map(*[F.lit(x) for pair in exact.items() for x in pair]), low)]
    for n, (how, what, *_) in enumerate(RULES):
        if how == "dist-info":
            test = slashed.rlike(r"(^|/)[^/]+\.dist-info/METADATA\z")
        elif how == "installed":
            test = (F.col("_name") == what) & F.concat(F.lit("/"), slashed, F.lit("/")).contains("/node_modules/")
        elif how == "gradle-lock":
            locks = F.concat(F.lit("/"), lower(slashed)).contains("/gradle/dependency-locks/")
            test = (low == "gradle.lockfile") | (low.endswith(".lockfile") & locks)
        elif how == "like":
            test = low.rlike(f"(?s){what}")
        else:
            continue
        numbers.append(F.when(test, F.lit(n)))
    # a generated column: filters on what follows from it don't repeat the tests
    ruled = named.withColumn("_rule", F.explode(F.array(F.least(*numbers))))
    pick = lambda at: F.get(F.array(*[F.lit(r[at]) for r in RULES]), F.col("_rule"))
    names = ("artifact_type", "ecosystem", "parser", "partial")
    return ruled.select(*files.columns, *[pick(at).alias(c) for at, c in enumerate(names, 2)])


def size_limit(parser: Column) -> Column:
    """Most bytes that a parser reads; 0 for no limit."""
    out = F.lit(8 * MIB)
    for n, parsers in LIMITS.items():
        out = F.when(parser.isin(*parsers), n).otherwise(out)
    return out.cast("long")


def gate(artifacts: DataFrame) -> DataFrame:
    """Adds status and message of what is decided before parsing: unsupported files, and
    files over their parser's limit, which are neither hashed nor parsed."""
    limit = size_limit(F.col("parser"))
    unread = F.col("parser").isin(*LIMITS[0])
    over = (limit > 0) & (F.col("file_size") > limit)
    status = F.when(unread, "detected but unsupported").when(over, "failed").when(F.col("partial"), "partially parsed").otherwise("parsed")
    message = F.when(F.col("parser") == "license-evidence", "License evidence only; no license is inferred.").when(
        unread, "No parser reads this format."
    ).when(
        over, F.concat(F.lit("The file exceeds its limit of "), limit.cast("string"), F.lit(" bytes."))
    )
    return artifacts.withColumn("status", status).withColumn("message", F.coalesce(message, F.lit("")))


def counters(artifacts: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return artifacts.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"),
        n("parsed").alias("parsed"),
        n("partially parsed").alias("partially_parsed"),
        n("detected but unsupported").alias("unsupported"),
        n("failed").alias("failed"),
    )
