"""Canonical relations. Text columns hold '' where nothing is known."""

DECLARED_HASH = "struct<algorithm:string,digest:string,subject:string,source_artifact:string,source_parser:string>"
ARTIFACT = (
    "relative_path string, absolute_path string, artifact_type string, ecosystem string, status string, "
    "parser string, file_size bigint, sha256 string, message string, component_count int"
)
COMPONENT = (
    "component_type string, name string, version string, ecosystem string, package_url string, cpe string, "
    "cpe_evidence string, company_name string, product_name string, native_soname string, native_build_id string, "
    "source_artifact string, source_parser string, dependency_scope string, sha256 string, "
    "evidence_paths array<string>, declared_licenses array<string>, declared_publishers array<string>, "
    f"declared_hashes array<{DECLARED_HASH}>"
)
#: Component columns by how merging treats them.
FIRST_FIELDS = ["component_type", "name", "version", "ecosystem", "package_url"]
LEAST_FIELDS = [
    "cpe", "cpe_evidence", "company_name", "product_name", "native_soname", "native_build_id", "source_artifact",
    "source_parser", "sha256",
]
SET_FIELDS = {"evidence_paths": False, "declared_licenses": True, "declared_publishers": True}  # whether case folds
COMPONENT_FIELDS = [c.split(" ", 1)[0] for c in COMPONENT.replace(f"<{DECLARED_HASH}>", "").split(", ")]
CHANGE_KINDS = ("added", "removed", "version_changed")
