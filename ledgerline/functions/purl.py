"""Package URLs: building, versionless identity, and the form for advisory lookups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import lower, trim
from .versions import is_exact_in

#: The package-URL type of each ecosystem, and the types whose names keep
#: their slashes.
PURL_TYPES = {
    "npm": "npm", "pypi": "pypi", "gradle": "maven", "conda": "conda", "go": "golang", "cargo": "cargo",
    "nuget": "nuget", "composer": "composer", "rubygems": "gem", "cocoapods": "cocoapods", "swift": "swift",
    "vcpkg": "generic", "conan": "conan",
}
SLASH_ECOSYSTEMS = ("composer", "go", "swift")
#: Types that advisories know, and the namespaces of distribution types.
ADVISORY_TYPES = (
    "apk", "bitnami", "cargo", "composer", "conan", "cran", "deb", "dhi", "gem", "golang", "gradle", "hackage", "hex",
    "julia", "maven", "npm", "nuget", "opam", "pub", "pypi", "rpm", "swift",
)
DISTRIBUTIONS = {
    "apk": ("alpaquita", "alpine", "bellsoft-hardened-containers", "chainguard", "dhi", "minimos", "wolfi"),
    "deb": ("debian", "dhi", "echo", "ubuntu"),
    "rpm": ("almalinux", "azure-linux", "mageia", "openeuler", "opensuse", "redhat", "rocky-linux", "suse"),
}
MAX_LOOKUP_BYTES = 4096
UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def percent_encode(c: Column, keep_slash: bool = False) -> Column:
    """UTF-8 bytes outside A-Z a-z 0-9 . _ - ~ as upper-case escapes."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *([("%2F", "/")] if keep_slash else [])):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def package_url(ecosystem: Column, name: Column, version: Column) -> Column:
    """The package URL of an exact version in a known ecosystem; else empty."""
    # nothing to trim, fold or encode, and a version that is exact: most of a lock file's entries
    plain = (ecosystem == "npm") & name.rlike(r"^[a-z0-9][a-z0-9._\-]*+\z") & version.rlike(r"^[0-9]++\.[0-9]++\.[0-9]++\z")
    quick = F.concat(F.lit("pkg:npm/"), name, F.lit("@"), version)
    eco, name, version = lower(trim(ecosystem)), trim(name), trim(version)
    folded = lower(name)
    npm = F.when(name.rlike(r"(?s)^(?:@[^/]+/|[^@/])[^/]*+(?<!/)\z"), percent_encode(folded, keep_slash=True))
    pypi = F.when(
        name.rlike(r"^[A-Za-z0-9]([A-Za-z0-9._\-]*[A-Za-z0-9])?\z"),
        F.regexp_replace(folded, r"[._\-]+", "-"),
    )
    group, artifact = trim(F.split_part(name, F.lit(":"), F.lit(1))), trim(F.split_part(name, F.lit(":"), F.lit(2)))
    gradle = F.when(
        name.rlike(r"(?s)^[^:]+:[^:]+\z") & (group != "") & (artifact != ""),
        F.concat(percent_encode(group), F.lit("/"), percent_encode(artifact)),
    )
    path = (
        F.when(eco == "npm", npm)
        .when(eco == "pypi", pypi)
        .when(eco == "gradle", gradle)
        .when(eco.isin(*SLASH_ECOSYSTEMS), percent_encode(name, keep_slash=True))
        .otherwise(percent_encode(name))
    )
    kinds = F.create_map(*[F.lit(x) for pair in PURL_TYPES.items() for x in pair])
    made = F.concat(F.lit("pkg:"), kinds[eco], F.lit("/"), path, F.lit("@"), percent_encode(version))
    return F.when(plain, quick).when((name != "") & is_exact_in(eco, version), F.coalesce(made, F.lit(""))).otherwise("")


def maven_url(group: Column, artifact: Column, version: Column) -> Column:
    whole = (group != "") & (artifact != "") & is_exact_in(F.lit("maven"), version)
    made = F.concat(F.lit("pkg:maven/"), percent_encode(group), F.lit("/"), percent_encode(artifact), F.lit("@"), percent_encode(trim(version)))
    return F.when(whole, made).otherwise("")


def binary_url(name: Column, version: Column, sha256: Column) -> Column:
    """A generic package URL for a binary of known version and digest."""
    from .versions import is_exact_binary

    ok = (trim(name) != "") & is_exact_binary(trim(version)) & sha256.rlike(r"^[0-9A-Fa-f]{64}\z")
    made = F.concat(F.lit("pkg:generic/"), percent_encode(trim(name)), F.lit("@"), percent_encode(trim(version)), F.lit("?checksum=sha256:"), lower(sha256))
    return F.when(ok, made).otherwise("")


def canonical_data(value: str, forbid_slash: bool, forbid_space: bool = False) -> str | None:
    """Normalised percent escapes of one part; None where it isn't valid."""
    raw = value.encode()
    at, decoded, out = 0, bytearray(), []
    while at < len(raw):
        b = raw[at]
        if b == 0x25:
            try:
                b = int(raw[at + 1 : at + 3].decode("ascii") if len(raw) >= at + 3 and raw[at + 1 : at + 3].isalnum() else "", 16)
            except ValueError:
                return None
            at += 3
        elif b in UNRESERVED or b == 0x3A:
            at += 1
        else:
            return None
        if b < 32 or b == 127 or (forbid_space and b == 32) or (forbid_slash and b == 0x2F):
            return None
        decoded.append(b)
        out.append(chr(b) if b in UNRESERVED or b == 0x3A else f"%{b:02X}")
    try:
        decoded.decode()
    except ValueError:
        return None
    return "".join(out)


def _segments(value: str, subpath: bool) -> str | None:
    parts = value.strip("/").split("/")
    out = []
    for k, part in enumerate(parts):
        made = canonical_data(part, subpath or k + 1 < len(parts)) if part else None
        if not made or (subpath and made in (".", "..")):
            return None
        out.append(made)
    return "/".join(out)


def _qualifiers(value: str) -> str | None:
    pairs: dict[str, str] = {}
    for pair in value.split("&"):
        key, eq, data = pair.partition("=")
        made = canonical_data(data, False) if eq else None
        ok = key[:1].islower() and key.isascii() and all(c.islower() or c.isdigit() or c in ".-_" for c in key)
        if not ok or not made or key in pairs:
            return None
        pairs[key] = made
    return "&".join(f"{k}={v}" for k, v in sorted(pairs.items()))


def versionless_identity(purl: str | None) -> str:
    """The package URL without its version, in canonical form, under 'purl:'; empty for
    what isn't a package URL."""
    value = (purl or "").strip("".join(map(chr, range(33))))
    if value[:4].lower() != "pkg:" or any(ord(c) < 33 or ord(c) == 127 for c in value):
        return ""
    value = value[4:].lstrip("/")
    core, has_fragment, fragment = value.partition("#")
    core, has_query, query = core.partition("?")
    if value.count("#") > 1 or value.count("?") > 1 or "?" in fragment:
        return ""
    if (has_fragment and not fragment) or (has_query and not query):
        return ""
    kind, slash, path = core.partition("/")
    if not slash or not path or not kind[:1].isalpha() or not kind.isascii() or not all(c.isalnum() or c in ".-" for c in kind):
        return ""
    if path.count("@") > 1:
        return ""
    path, has_version, version = path.partition("@")
    if has_version and not canonical_data(version, False):
        return ""
    made = _segments(path, False) if path.strip("/") else None
    qualifiers = _qualifiers(query) if has_query else ""
    subpath = (_segments(fragment, True) if fragment.strip("/") else None) if has_fragment else ""
    if not made or qualifiers is None or subpath is None:
        return ""
    return f"purl:pkg:{kind.lower()}/{made}" + (f"?{qualifiers}" if qualifiers else "") + (f"#{subpath}" if subpath else "")


@F.pandas_udf(StringType())
def _identity_udf(purl: pd.Series) -> pd.Series:
    return purl.map(lambda p: None if p is None else versionless_identity(p))


#: Package URLs in which nothing is left to normalise but the type's case.
PLAIN = r"^[pP][kK][gG]:([A-Za-z][A-Za-z0-9.\-]*)/([A-Za-z0-9._~:\-]+(?:/[A-Za-z0-9._~:\-]+)*)(?:@[A-Za-z0-9._~:\-]+)?\z"


def strong_identity(purl: Column) -> Column:
    """versionless_identity as a column; plain package URLs, nearly all of them, never
    leave the JVM."""
    value = trim(purl)
    plain = value.rlike(PLAIN)
    quick = F.concat(F.lit("purl:pkg:"), lower(F.regexp_extract(value, PLAIN, 1)), F.lit("/"), F.regexp_extract(value, PLAIN, 2))
    other = _identity_udf(F.when(~plain & (value != ""), value))
    return F.when(plain, quick).otherwise(F.coalesce(other, F.lit("")))




#: path@version in which nothing is left to normalise, and whose segments are no dots.
PLAIN_LOOKUP = r"^(?!(?:.*/)?\.{1,2}[/@])[A-Za-z0-9._~:\-]+(?:/[A-Za-z0-9._~:\-]+)*@[A-Za-z0-9._~:\-]+\z"


def _lookup_path_of(purl: Column) -> Column:
    """lookup_path of a package URL's path and version; those in plain form, nearly all
    of them, never leave the JVM."""
    core = F.substring(purl, 5, MAX_LOOKUP_BYTES)
    rest = F.regexp_extract(core, r"(?s)^[A-Za-z][A-Za-z0-9.+\-]*/([^@]+@[^@]+)\z", 1)
    plain = rest.rlike(PLAIN_LOOKUP)
    return F.when(plain, rest).otherwise(_lookup_udf(F.when(~plain & (rest != ""), rest)))


def with_lookup(rows: DataFrame, purl: Column) -> DataFrame:
    """Adds reason and canonical for an advisory lookup: the reason is empty where the
    package URL is eligible; reasons are tested in their fixed order. Parts and reason are
    generated columns, so that filters on them don't repeat what they are made of."""
    core = F.substring(purl, 5, MAX_LOOKUP_BYTES)
    parts = F.struct(
        lower(F.regexp_extract(core, r"(?s)^([^/]*)/", 1)).alias("kind"),
        core.rlike(r"(?s)^[^/]*/[^@]*@").alias("versioned"),
        core.rlike(r"(?s)^[A-Za-z][A-Za-z0-9.+\-]*/.").alias("shaped"),
        F.col("_made").alias("made"),
    )
    out = rows.withColumn("_made", _lookup_path_of(purl)).withColumn("_parts", F.explode(F.array(parts)))
    kind, versioned, shaped, made = (F.col(f"_parts.{c}") for c in ("kind", "versioned", "shaped", "made"))
    out = out.withColumn("reason", F.explode(F.array(_reason(purl, kind, versioned, shaped, made))))
    canonical = F.when(F.col("reason") == "", F.concat(F.lit("pkg:"), kind, F.lit("/"), made)).otherwise("")
    return out.withColumn("canonical", canonical).drop("_made", "_parts")


def _reason(purl: Column, kind: Column, versioned: Column, shaped: Column, made: Column) -> Column:
    space = F.split_part(made, F.lit("/"), F.lit(1))
    known = F.lit(True)
    for t, names in DISTRIBUTIONS.items():
        known = F.when(kind == t, made.contains("/") & space.isin(*names)).otherwise(known)
    return (
        F.when(purl == "", "empty")
        .when(F.octet_length(purl) > MAX_LOOKUP_BYTES, "too-long")
        .when(~F.is_valid_utf8(purl), "invalid-utf8")
        .when(purl.rlike(r"[\x00-\x20\x7F]"), "whitespace-or-control")
        .when(lower(F.substring(purl, 1, 4)) != "pkg:", "not-package-url")
        .when(purl.contains("?"), "qualifiers-not-allowed")
        .when(purl.contains("#"), "subpath-not-allowed")
        .when(~shaped, "malformed-package-url")
        .when(kind == "generic", "generic-package-url")
        .when(~kind.isin(*ADVISORY_TYPES), "unsupported-ecosystem")
        .when(~versioned, "version-required")
        .when(made.isNull(), "malformed-package-url")
        .when(~known, "unsupported-ecosystem")
        .otherwise("")
    )


def lookup_path(value: str) -> str | None:
    """Canonical path@version of a lookup; None where it isn't valid."""
    path, _, version = value.partition("@")
    parts = [canonical_data(p, True, True) if p else None for p in path.split("/")]
    made = canonical_data(version, True, True)
    if not made or any(not p or p in (".", "..") for p in parts):
        return None
    return "/".join(parts) + "@" + made


@F.pandas_udf(StringType())
def _lookup_udf(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None else lookup_path(v))


