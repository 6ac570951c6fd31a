"""Keys under which components merge, compare and refer to each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SEPARATOR, has_token, key_part, lower, trim
from .versions import is_exact, is_exact_in, is_range_in, soname_abi

URN = "urn:ledgerline"
#: Scopes that a document leaves to its default, calls optional, or excludes.
REQUIRED = ("runtime", "build", "build-dependencies", "project", "resolved", "compile", "provided", "system", "dependencies")
OPTIONAL = ("optional", "peer")
EXCLUDED = ("development", "dev-dependencies", "test", "import")
CARGO_MANIFEST = "conservative-cargo-toml"


def merge_key() -> Column:
    """Components with this key in common are one: the package URL, else the fields."""
    trimmed = lambda c: F.when((F.substring(c, 1, 1) > " ") & (F.substring(c, -1, 1) > " "), F.col(c)).otherwise(trim(F.col(c)))
    purl = trimmed("package_url")  # nearly all are trimmed, and every row is asked for its key
    fields = F.concat_ws(
        SEPARATOR,
        lower(trimmed("ecosystem")),
        lower(trimmed("name")),
        trimmed("version"),
        lower(trimmed("component_type")),
    )
    return F.when(purl != "", F.concat(F.lit("purl:"), purl)).otherwise(F.concat(F.lit("fields:"), fields))


def weak_identity() -> Column:
    """Identity without a package URL: ecosystem, case-sensitive name, type. Nameless
    components are told apart by their source."""
    eco, kind = lower(trim(F.col("ecosystem"))), lower(trim(F.col("component_type")))
    name, source = trim(F.col("name")), trim(F.col("source_artifact"))
    return F.when(
        name == "", F.concat(F.lit("invalid-fields:"), key_part(eco), key_part(kind), key_part(source))
    ).otherwise(F.concat(F.lit("fields:"), key_part(eco), key_part(name), key_part(kind)))


def _cargo_requirement() -> Column:
    return (lower(trim(F.col("source_parser"))) == CARGO_MANIFEST) & ~has_token(F.col("dependency_scope"), "project")


def has_exact_version() -> Column:
    """Whether a document may state the version: exact, no requirement of a Cargo
    manifest, and no mere ABI number of a shared library."""
    version = F.col("version")
    abi = soname_abi(F.col("ecosystem"), F.col("name"))
    return is_exact_in(F.col("ecosystem"), version) & ~_cargo_requirement() & ~((abi != "") & (trim(version) == abi))


def requested_range() -> Column:
    version = F.col("version")
    ranged = is_range_in(F.col("ecosystem"), version) | (_cargo_requirement() & is_exact(version))
    return F.when(ranged, trim(version)).otherwise("")


def component_ref() -> Column:
    """The reference of a component inside a document."""
    key = F.concat_ws(
        SEPARATOR, lower(F.col("ecosystem")), lower(F.col("name")), F.col("version"), lower(F.col("component_type"))
    )
    urn = F.concat(F.lit(f"{URN}:component:"), F.substring(F.sha2(key, 256), 1, 32))
    return F.when((F.col("package_url") != "") & has_exact_version(), F.col("package_url")).otherwise(urn)


def root_ref(name: Column) -> Column:
    key = F.concat_ws(SEPARATOR, F.lit("application"), lower(trim(name)))
    return F.concat(F.lit(f"{URN}:application:"), F.substring(F.sha2(key, 256), 1, 32))


def document_scope() -> Column:
    scope = F.col("dependency_scope")
    any_of = lambda names: F.exists(F.transform(F.split(scope, ","), trim), lambda t: lower(t).isin(*names))
    return F.when(any_of(REQUIRED), "").when(any_of(OPTIONAL), "optional").when(any_of(EXCLUDED), "excluded").otherwise("")


def row_key(kind: Column, identity: Column, before: Column, after: Column) -> Column:
    """kind: its ordinal."""
    return F.concat(kind.cast("string"), F.lit(":"), key_part(identity), key_part(before), key_part(after))
