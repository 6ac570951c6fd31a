"""Inventory relations derived from the star-schema tables, so that every operator runs
on tables of any size. Each is a projection that SQL can state too (plans/oracles.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the adapters.
ECOSYSTEM_OF = {
    "ECONOMY": ("npm", "npm"), "PROMO": ("PyPI", "pypi"), "LARGE": ("Maven", "maven"), "SMALL": ("NuGet", "nuget"),
    "MEDIUM": ("Cargo", "cargo"), "STANDARD": ("Composer", "composer"),
}
SCOPE_OF = {"A": "development", "N": "runtime", "R": "optional, peer"}
LICENSES = ("MIT", "mit", "Apache-2.0", "")
SPLIT_DATE = "1998-06-01"
FILES = (
    "package.json", "app/node_modules/x/package.json", "package-lock.json", "requirements.txt", "requirements-dev.TXT",
    "pyproject.toml", "poetry.lock", "Pipfile", "Pipfile.lock", "environment.yml", "environment.yaml", "go.mod",
    "go.sum", "Cargo.toml", "cargo.lock", "pom.xml", "build.gradle", "build.gradle.kts", "gradle.lockfile",
    "gradle/dependency-locks/main.lockfile", "other.lockfile", "app.csproj", "packages.lock.json",
    "Directory.Packages.props", "composer.json", "composer.lock", "Gemfile", "Gemfile.lock", "vcpkg.json",
    "conanfile.txt", "Package.resolved", "Podfile.lock", "yarn.lock", "pnpm-lock.yaml", "pnpm-lock.yml", "tool.lpi",
    "tool.lpk", "LICENSE", "license.md", "COPYING.txt", "notice", "demo-1.0.dist-info/METADATA", "dist-info/METADATA",
    ".git/config", "venv/lib/a.py", "src/main.c", "README.md", "bin/tool", "lib/libz.so.1", "lib/a.jar",
)


def _choice(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw component rows of two snapshots: columns of a component, side, ordinal."""
    pick = lambda k: F.create_map(*[F.lit(x) for t, v in ECOSYSTEM_OF.items() for x in (t, v[k])])[F.col("p_type")]
    folder = F.concat(F.lit("pkg:"), pick(1), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"))
    # what a part alone decides is made once for all of its lines
    part = _table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_size", F.replace("p_name", F.lit(" "), F.lit("-")).alias("stem"), pick(0).alias("ecosystem"), folder.alias("folder")
    )
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"
    )
    key = F.col("p_partkey")
    side = F.when(F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"), "baseline").otherwise("current")
    # a fifth of the parts is renamed on either side: removed, and added
    renamed = F.when((F.col("side") == "baseline") & (key % 5 == 1), "-old").when((F.col("side") == "current") & (key % 5 == 0), "-new").otherwise("")
    minor = F.when((F.col("side") == "current") & (key % 6 == 2), "1").otherwise("0")
    path = F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string"), F.lit("/manifest.json"))
    license_ = _choice(F.col("p_size") % 4, LICENSES)
    empty = F.lit("")
    return (
        lines.join(part, F.col("l_partkey") == key)
        .withColumn("side", side)
        .withColumn("version", F.concat((key % 7).cast("string"), F.lit("."), minor, F.lit(".0")))
        .withColumn("name", F.concat("stem", renamed))
        .select(
            _choice(F.col("p_size") % 3, ("library", "application", "file")).alias("component_type"),
            "name",
            "version",
            "ecosystem",
            F.when(key % 4 == 0, "").otherwise(F.concat("folder", "name", F.lit("@"), "version")).alias("package_url"),
            empty.alias("cpe"),
            empty.alias("cpe_evidence"),
            F.when(key % 3 == 0, F.col("p_brand")).otherwise("").alias("company_name"),
            empty.alias("product_name"),
            empty.alias("native_soname"),
            empty.alias("native_build_id"),
            path.alias("source_artifact"),
            _choice(F.col("l_linenumber") % 2, ("package-json", "package-lock-json")).alias("source_parser"),
            F.create_map(*[F.lit(x) for kv in SCOPE_OF.items() for x in kv])[F.col("l_returnflag")].alias("dependency_scope"),
            empty.alias("sha256"),
            F.array(path).alias("evidence_paths"),
            F.when(license_ == "", F.array().cast("array<string>")).otherwise(F.array(license_)).alias("declared_licenses"),
            F.array().cast("array<string>").alias("declared_publishers"),
            F.array().cast("array<struct<algorithm:string,digest:string,subject:string,source_artifact:string,source_parser:string>>").alias("declared_hashes"),
            "side",
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ordinal"),
        )
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, relative_path, file_size: one file per document."""
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), _choice(F.col("doc_id") % len(FILES), FILES)).alias("relative_path"),
        (F.col("n_chars") * (1 + F.col("doc_id") % 9) * 1000).cast("long").alias("file_size"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative_path, status, ordinal of the files that components come from."""
    return _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string"), F.lit("/manifest.json")).alias("relative_path"),
        _choice(F.col("s_suppkey") % 4, ("parsed", "partially parsed", "detected but unsupported", "failed")).alias("status"),
        F.col("s_suppkey").alias("ordinal"),
    )


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package_url, advisory_id, modified, with repeats of a pair."""
    part = _table(spark, sf_dir, "part")
    kind = F.create_map(*[F.lit(x) for t, v in ECOSYSTEM_OF.items() for x in (t, v[1])])[F.col("p_type")]
    key = F.col("p_partkey")
    return part.select(
        F.concat(
            F.lit("pkg:"), kind, F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"),
            F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("@"), (key % 7).cast("string"), F.lit(".0.0"),
        ).alias("package_url"),
        F.concat(F.lit("ADV-"), (key % 40).cast("string")).alias("advisory_id"),
        F.concat(F.lit("2024-0"), (1 + key % 9).cast("string"), F.lit("-01T00:00:00Z")).alias("modified"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan tasks: one per user and day of events."""
    events = _table(spark, sf_dir, "events")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    day = F.to_date("ts").alias("day")
    n = lambda kind: F.count_if(F.col("event_type") == kind).cast("long")
    grouped = events.groupBy("user_id", day).agg(
        iso(F.min("ts")).alias("created_utc"),
        iso(F.max("ts")).alias("completed_utc"),
        F.count(F.lit(1)).alias("files_inspected"),
        n("error").alias("warnings"),
        n("signup").alias("errors"),
        n("purchase").alias("matches"),
        F.sum(F.get_json_object("props", "$.k").cast("long")).alias("bytes_inspected"),
    )
    return grouped.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("day").cast("string")).alias("id"),
        "created_utc",
        "completed_utc",
        _choice((F.col("user_id") + F.dayofmonth("day")) % 5, ("pending", "running", "completed", "cancelled", "failed")).alias("status"),
        F.concat(F.lit("root-"), (F.col("user_id") % 10).cast("string")).alias("target_root_name"),
        "files_inspected",
        "bytes_inspected",
        "warnings",
        "errors",
        "matches",
    )
