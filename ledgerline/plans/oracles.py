"""DuckDB SQL for the results of the queries, stated independently of their plans."""

from __future__ import annotations

from ..functions.text import LOWER, UPPER
from ..operators.classify import LIMITS, RULES
from ..sources.adapters import FILES, LICENSES
from . import formats, images, strictness, surface
from .queries import ECOSYSTEMS, LIBRARIES, NAMES, PURL_VERSIONS, PURLS, STRONG, VERSIONS


def _text(s: str) -> str:
    plain = "".join(c if c != "'" else "''" for c in s)
    return "'" + plain.replace("\t", "' || chr(9) || '") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _pick(**lists) -> str:
    filled = lambda v: strictness.filled_sql(v).replace(chr(9), "' || chr(9) || '")
    columns = ", ".join(f"[{', '.join(map(filled, v))}][p_partkey % {len(v)} + 1] AS {k}" for k, v in lists.items())
    return f"SELECT p_partkey AS id, {columns} FROM part"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


ECO = "CASE p_type WHEN 'ECONOMY' THEN 'npm' WHEN 'PROMO' THEN 'PyPI' WHEN 'LARGE' THEN 'Maven' WHEN 'SMALL' THEN 'NuGet' WHEN 'MEDIUM' THEN 'Cargo' WHEN 'STANDARD' THEN 'Composer' END"
PURL_FOLDER = f"'pkg:' || lower({ECO}) || '/' || lower(replace(p_brand, '#', '')) || '/'"
PURL_START = f"{PURL_FOLDER} || replace(p_name, ' ', '-') || '@'"

RAW = f"""raw AS (
  SELECT * FROM (
    SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 'baseline' ELSE 'current' END AS side,
      ['library', 'application', 'file'][p_size % 3 + 1] AS component_type,
      replace(p_name, ' ', '-') || CASE WHEN side = 'baseline' AND p_partkey % 5 = 1 THEN '-old' WHEN side = 'current' AND p_partkey % 5 = 0 THEN '-new' ELSE '' END AS name,
      (p_partkey % 7) || '.' || CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' AND p_partkey % 6 = 2 THEN '1' ELSE '0' END || '.0' AS version,
      {ECO} AS ecosystem, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE {PURL_FOLDER} || name || '@' || version END AS package_url,
      CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS company_name,
      'supplier-' || l_suppkey || '/manifest.json' AS source_artifact,
      ['package-json', 'package-lock-json'][l_linenumber % 2 + 1] AS source_parser,
      CASE l_returnflag WHEN 'A' THEN 'development' WHEN 'N' THEN 'runtime' ELSE 'optional, peer' END AS dependency_scope,
      {_list(LICENSES)}[p_size % 4 + 1] AS license, l_orderkey * 10 + l_linenumber AS ordinal, p_partkey
    FROM lineitem JOIN part ON l_partkey = p_partkey)),
keyed AS (
  SELECT *, CASE WHEN package_url <> '' THEN 'purl:' || package_url
    ELSE 'fields:' || lower(ecosystem) || chr(1) || lower(name) || chr(1) || version || chr(1) || lower(component_type) END AS k FROM raw)"""

NORM = f"""{RAW},
scopes AS (SELECT side, k, string_agg(DISTINCT t, ', ' ORDER BY t) AS dependency_scope
  FROM (SELECT side, k, unnest(string_split(dependency_scope, ', ')) AS t FROM keyed) GROUP BY side, k),
licensed AS (SELECT side, k, string_agg(v, ',' ORDER BY f) AS licenses FROM (
  SELECT side, k, lower(license) AS f, arg_min(license, ordinal) AS v FROM keyed WHERE license <> '' GROUP BY 1, 2, 3) GROUP BY side, k),
norm AS (
  SELECT g.*, s.dependency_scope, coalesce(l.licenses, '') AS licenses FROM (
    SELECT side, k, arg_min(component_type, ordinal) AS component_type, arg_min(name, ordinal) AS name, arg_min(version, ordinal) AS version,
      arg_min(ecosystem, ordinal) AS ecosystem, arg_min(package_url, ordinal) AS package_url,
      coalesce(min(nullif(company_name, '')), '') AS company_name, min(source_artifact) AS source_artifact, min(source_parser) AS source_parser,
      string_agg(DISTINCT source_artifact, ',' ORDER BY source_artifact) AS evidence, min(ordinal) AS first_ordinal
    FROM keyed GROUP BY side, k) g
  JOIN scopes s USING (side, k) LEFT JOIN licensed l USING (side, k))"""

COMPARED = f"""{NORM},
snap AS (
  SELECT *, CASE WHEN package_url = '' THEN '' ELSE 'purl:' || regexp_replace(package_url, '@[^@]*$', '') END AS strong,
    'fields:' || strlen(ecosystem) || ':' || lower(ecosystem) || strlen(name) || ':' || name || strlen(component_type) || ':' || lower(component_type) AS weak
  FROM norm),
weak AS (SELECT weak, count(DISTINCT nullif(strong, '')) AS n, min(nullif(strong, '')) AS only, bool_or(strong = '') AS missing FROM snap GROUP BY weak),
given AS (
  SELECT s.*, CASE WHEN strong <> '' THEN strong WHEN w.n = 1 THEN w.only ELSE s.weak END AS identity,
    (CASE WHEN strong <> '' THEN '0' ELSE '1' END) || (SELECT string_agg(strlen(x) || ':' || x, '' ORDER BY i)
      FROM (SELECT unnest([package_url, name, ecosystem, component_type, dependency_scope, source_artifact, source_parser, '']) AS x, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8], 1) AS i)) AS tie
  FROM snap s JOIN weak w USING (weak)),
vers AS (
  SELECT identity, side, version, count(*) AS n, arg_min({{'name': name, 'ecosystem': ecosystem, 'type': component_type, 'purl': package_url, 'scope': dependency_scope}}, tie) AS item
  FROM given GROUP BY identity, side, version),
pairs AS (
  SELECT identity, version, max(item) FILTER (side = 'baseline') AS b, max(item) FILTER (side = 'current') AS a FROM vers GROUP BY identity, version),
per AS (SELECT identity, count(b) AS n_b, count(a) AS n_a, count(*) FILTER (b IS NOT NULL AND a IS NOT NULL) AS n_both FROM pairs GROUP BY identity),
kinds AS (
  SELECT 'version_changed' AS kind, x.identity, x.version AS before_version, y.version AS after_version, x.b, y.a
    FROM pairs x JOIN pairs y USING (identity) JOIN per USING (identity)
    WHERE n_b = 1 AND n_a = 1 AND n_both = 0 AND x.b IS NOT NULL AND y.a IS NOT NULL
  UNION ALL
  SELECT CASE WHEN b IS NOT NULL THEN 'removed' ELSE 'added' END, identity, CASE WHEN b IS NOT NULL THEN version ELSE '' END,
      CASE WHEN a IS NOT NULL THEN version ELSE '' END, b, a
    FROM pairs JOIN per USING (identity) WHERE (b IS NULL OR a IS NULL) AND NOT (n_b = 1 AND n_a = 1 AND n_both = 0)),
changes AS (
  SELECT kind, (CASE kind WHEN 'added' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END) || ':' || strlen(identity) || ':' || identity || strlen(before_version) || ':' || before_version || strlen(after_version) || ':' || after_version AS row_key,
    identity AS identity_key, coalesce(a.name, b.name) AS name, coalesce(a.ecosystem, b.ecosystem) AS ecosystem, coalesce(a.type, b.type) AS component_type,
    before_version, after_version, coalesce(b.purl, '') AS before_package_url, coalesce(a.purl, '') AS after_package_url,
    coalesce(b.scope, '') AS before_scope, coalesce(a.scope, '') AS after_scope FROM kinds)"""

PATHS = f"""files AS (SELECT doc_id, source || '/' || {_list(FILES)}[doc_id % {len(FILES)} + 1] AS relative_path, n_chars * (1 + doc_id % 9) * 1000 AS file_size FROM documents),
named AS (SELECT *, regexp_extract(relative_path, '[^/]*$') AS base, lower(base) AS low FROM files)"""


def _rule(how: str, what: str) -> str:
    return {
        "dist-info": r"regexp_matches(relative_path, '(^|/)[^/]+\.dist-info/METADATA$')",
        "installed": f"base = '{what}' AND contains('/' || relative_path, '/node_modules/')",
        "gradle-lock": "low = 'gradle.lockfile' OR (low LIKE '%.lockfile' AND contains(lower('/' || relative_path), '/gradle/dependency-locks/'))",
        "name": f"low = '{what}'",
        "like": f"regexp_matches(low, '{what.replace(chr(92) + 'z', '$')}')",
    }[how]


def _rules(at: int) -> str:
    return "CASE " + " ".join(f"WHEN {_rule(r[0], r[1])} THEN {repr(r[at]) if at < 5 else r[at]}" for r in RULES) + " END"


LIMIT = "CASE " + " ".join(f"WHEN parser IN ({', '.join(map(repr, ps))}) THEN {n}" for n, ps in LIMITS.items()) + f" ELSE {8 << 20} END"
CLASSIFIED = f"""{PATHS},
ruled AS (SELECT *, {_rules(2)} AS artifact_type, {_rules(3)} AS ecosystem, {_rules(4)} AS parser, {_rules(5)} AS partial FROM named),
gated AS (SELECT *, CASE WHEN {LIMIT} = 0 THEN 'detected but unsupported' WHEN file_size > {LIMIT} THEN 'failed' WHEN partial THEN 'partially parsed' ELSE 'parsed' END AS status
  FROM ruled WHERE artifact_type IS NOT NULL)"""

IGNORE_NAMES = ".git .svn .hg .idea .vscode .cache __pycache__ node_modules .venv venv".split()
IGNORE_ANY = " OR ".join(f"s = '{n}'" for n in IGNORE_NAMES)

V = "v"
SOURCE = (
    "(" + " OR ".join(f"contains({V}, {_text(x)})" for x in ("://", "git+", "file:", "link:", "workspace:", "path:", "/", "\\", "#", "$", "{", "}"))
    + " OR " + " OR ".join(f"starts_with({V}, '{x}')" for x in ("npm:", "github:", "gitlab:", "bitbucket:", "ssh:", "git:", "git@")) + ")"
)
VERSIONED = f"""shaped AS (SELECT *, {_low(_trim('version'))} AS v, lower({_trim('ecosystem')}) = 'npm' AS npm FROM picked),
judged AS (SELECT *, {SOURCE} AS is_source,
    v <> '' AND NOT {SOURCE} AND (len(regexp_extract_all(v, '[<>=~^*|, \\[\\]()]')) > 0 OR v LIKE '%+' OR list_contains(regexp_split_to_array(v, '[.-]'), 'x')) AS is_range,
    v <> '' AND NOT {SOURCE} AND NOT is_range AND v NOT IN ('latest', 'next', 'stable') AND NOT starts_with(v, 'latest.') AS is_exact,
    regexp_full_match(v, 'v?[0-9]+[.][0-9]+[.][0-9]+([-+][a-z0-9.+-]+)?') AS three,
    regexp_full_match(v, 'v?[0-9]+([.][0-9]+)?') AS few FROM shaped)"""

GUESS = f"""named AS (SELECT *, lower({_trim('ecosystem')}) AS e, {_trim('name')} AS n, {_trim('version')} AS ver FROM judged),
path AS (SELECT *, CASE
    WHEN e = 'npm' THEN CASE WHEN regexp_full_match(n, '@[^/]+/[^/]+') THEN url_encode(split_part({_low('n')}, '/', 1)) || '/' || url_encode(split_part({_low('n')}, '/', 2))
      WHEN n NOT LIKE '@%' AND n NOT LIKE '%/%' THEN url_encode({_low('n')}) END
    WHEN e = 'pypi' THEN CASE WHEN regexp_full_match(n, '[A-Za-z0-9]|[A-Za-z0-9][A-Za-z0-9._-]*[A-Za-z0-9]') THEN regexp_replace({_low('n')}, '[._-]+', '-', 'g') END
    WHEN e = 'gradle' THEN CASE WHEN regexp_full_match(n, '[^:]+:[^:]+') THEN url_encode(split_part(n, ':', 1)) || '/' || url_encode(split_part(n, ':', 2)) END
    WHEN e IN ('composer', 'go', 'swift') THEN replace(url_encode(n), '%2F', '/') ELSE url_encode(n) END AS p,
  CASE e WHEN 'npm' THEN 'npm' WHEN 'pypi' THEN 'pypi' WHEN 'gradle' THEN 'maven' WHEN 'conda' THEN 'conda' WHEN 'go' THEN 'golang' WHEN 'cargo' THEN 'cargo'
    WHEN 'nuget' THEN 'nuget' WHEN 'composer' THEN 'composer' WHEN 'rubygems' THEN 'gem' WHEN 'cocoapods' THEN 'cocoapods' WHEN 'swift' THEN 'swift'
    WHEN 'vcpkg' THEN 'generic' WHEN 'conan' THEN 'conan' END AS t FROM named)"""

LOOKED = f"""picked AS ({_pick(package_url=PURLS)}),
cut AS (SELECT *, lower(split_part(substr(package_url, 5), '/', 1)) AS t, regexp_replace(substr(package_url, 5), '^[^/]*/', '') AS rest FROM picked),
parts AS (SELECT *, split_part(rest, '@', 1) AS path, split_part(rest, '@', 2) AS ver, len(string_split(rest, '@')) - 1 AS ats FROM cut),
reasoned AS (SELECT *, CASE WHEN package_url = '' THEN 'empty' WHEN package_url LIKE '% %' THEN 'whitespace-or-control'
  WHEN lower(substr(package_url, 1, 4)) <> 'pkg:' THEN 'not-package-url' WHEN contains(package_url, '?') THEN 'qualifiers-not-allowed'
  WHEN contains(package_url, '#') THEN 'subpath-not-allowed' WHEN t = '' OR rest = '' THEN 'malformed-package-url' WHEN t = 'generic' THEN 'generic-package-url'
  WHEN t NOT IN ('npm', 'deb', 'rpm', 'pypi') THEN 'unsupported-ecosystem' WHEN ats = 0 THEN 'version-required'
  WHEN ats > 1 OR path = '' OR ver = '' OR path LIKE '/%' OR contains('/' || path || '/', '/../') THEN 'malformed-package-url'
  WHEN t = 'deb' AND NOT starts_with(path, 'debian/') OR t = 'rpm' THEN 'unsupported-ecosystem' ELSE '' END AS reason FROM parts),
looked AS (SELECT id, package_url, reason, CASE WHEN reason = '' THEN 'pkg:' || t || '/' || path || '@' || ver ELSE '' END AS canonical FROM reasoned)"""

ADVISORIES = f"""adv AS (SELECT {PURL_START} || (p_partkey % 7) || '.0.0' AS package_url, 'ADV-' || (p_partkey % 40) AS advisory_id, '2024-0' || (1 + p_partkey % 9) || '-01T00:00:00Z' AS modified
  FROM part),
known AS (SELECT package_url, advisory_id, max(modified) AS modified FROM adv GROUP BY 1, 2)"""

TASKS = """tasks AS (
  SELECT user_id || '-' || CAST(day AS VARCHAR) AS id, strftime(lo, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_utc, lo, hi,
    ['pending', 'running', 'completed', 'cancelled', 'failed'][(user_id + day(day)) % 5 + 1] AS status, 'root-' || (user_id % 10) AS target_root_name, *
  FROM (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS lo, max(ts) AS hi, count(*) AS files_inspected, count(*) FILTER (event_type = 'error') AS warnings,
      count(*) FILTER (event_type = 'signup') AS errors, count(*) FILTER (event_type = 'purchase') AS matches, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS bytes_inspected
    FROM events GROUP BY user_id, CAST(ts AS DATE)))"""

REFS = """all_rows AS (
  SELECT 'tool-' || o_orderkey AS name, 'bin/tool-' || o_orderkey AS path, 'binary-header' AS parser, false AS runtime FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT 'lib' || l_partkey || '.so.1', 'bin/tool-' || l_orderkey, CASE WHEN l_linenumber = 1 THEN 'package-json' ELSE 'binary-dependency-table' END, l_returnflag <> 'A' FROM lineitem
  UNION ALL SELECT 'pkg-' || p_partkey, 'app/package.json', 'package-json', true FROM part),
refs AS (SELECT *, 'urn:ledgerline:component:' || substr(sha256('native' || chr(1) || name || chr(1) || '1' || chr(1) || 'library'), 1, 32) AS ref FROM all_rows),
owners AS (SELECT path, ref AS owner_ref FROM refs WHERE parser = 'binary-header'),
linked AS (SELECT DISTINCT owner_ref, ref AS dep_ref FROM refs JOIN owners USING (path) WHERE runtime AND ref <> owner_ref),
edges AS (
  SELECT 'root' AS owner_ref, ref AS dep_ref FROM (SELECT DISTINCT ref FROM refs WHERE path = 'app/package.json' OR (parser = 'package-json' AND false))
  UNION ALL SELECT * FROM linked
  UNION ALL SELECT DISTINCT owner_ref, NULL FROM owners WHERE owner_ref NOT IN (SELECT owner_ref FROM linked))"""

LIBS = _pick(library=LIBRARIES, ecosystem=("native", "Native", "npm"))

ORACLES: dict[str, str] = {
    "version_predicates": f"""WITH picked AS ({_pick(version=VERSIONS, ecosystem=("npm", "PyPI", "Cargo"))}), {VERSIONED}
SELECT id, version, ecosystem, is_source, is_range, is_exact, is_exact AND (NOT npm OR three) AS is_exact_in, is_range OR (npm AND is_exact AND few) AS is_range_in,
  regexp_full_match(version, '[0-9]+([.][0-9]+){{1,7}}') AND regexp_matches(version, '[1-9]') AS is_binary, regexp_full_match(version, '[0-9]+([.][0-9]+)*') AS is_dotted FROM judged""",
    "package_urls": f"""WITH picked AS ({_pick(ecosystem=ECOSYSTEMS, name=NAMES, version=PURL_VERSIONS)}), {VERSIONED}, {GUESS}
SELECT id, ecosystem, name, version, CASE WHEN n <> '' AND is_exact AND (NOT npm OR three) THEN coalesce('pkg:' || t || '/' || p || '@' || url_encode(ver), '') ELSE '' END AS purl FROM path""",
    "percent_encoding": "SELECT page_id, url_encode(url) AS encoded, replace(url_encode(url), '%2F', '/') AS with_slashes FROM pages",
    "native_versions": f"""WITH p AS ({LIBS}) SELECT id, library,
  CASE WHEN regexp_matches(lower(library), '[.]so[.][0-9]+([.][0-9]+)+$') THEN regexp_extract(lower(library), '[.]so[.]([0-9]+([.][0-9]+)+)$', 1)
    WHEN library LIKE '%.dylib' THEN regexp_extract(library, '[^.][.]([0-9]+([.][0-9]+)*)[.]dylib$', 1) ELSE '' END AS library_version,
  CASE WHEN lower(ecosystem) = 'native' AND regexp_full_match(substr(lower(library), strpos(lower(library), '.so.') + 4), '[0-9]+') AND contains(lower(library), '.so.')
    THEN substr(library, strpos(lower(library), '.so.') + 4) ELSE '' END AS abi, list_last(string_split(library, '/')) AS base FROM p""",
    "lookup_eligibility": f"WITH {LOOKED} SELECT * FROM looked",
    "lookup_counts": f"""WITH {LOOKED} SELECT count(DISTINCT canonical) FILTER (reason = '') AS eligible,
  count(*) FILTER (reason = '') - count(DISTINCT canonical) FILTER (reason = '') AS duplicates, count(*) FILTER (reason <> '') AS rejected FROM looked""",
    "lookup_rejections": f"WITH {LOOKED} SELECT reason, count(*) AS n FROM looked WHERE reason <> '' GROUP BY reason",
    "integrity_hashes": "SELECT p_partkey, 'SHA-256' AS algorithm, sha256(p_name) AS digest FROM part UNION ALL SELECT p_partkey, 'SHA-1', sha1(p_name) FROM part",
    "display_texts": """WITH t AS (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS n, o_custkey * 1300 AS ms FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1024.0 ** 2 THEN printf('%.1f', round(n / 1024.0, 1)) || ' KiB' WHEN n < 1024.0 ** 3 THEN printf('%.1f', round(n / 1024.0 ** 2, 1)) || ' MiB'
  WHEN n < 1024.0 ** 4 THEN printf('%.1f', round(n / 1024.0 ** 3, 1)) || ' GiB' ELSE printf('%.1f', round(n / 1024.0 ** 4, 1)) || ' TiB' END AS size_text,
  CASE WHEN ms < 60000 THEN printf('%.1f', round(ms / 1000.0, 1)) || ' s' ELSE (ms // 60000) || ' min ' || printf('%.1f', round((ms % 60000) / 1000.0, 1)) || ' s' END AS duration_text FROM t""",
    "ignored_paths": f"""WITH {PATHS}, parts AS (SELECT doc_id, relative_path, string_split(relative_path, '/') AS segments FROM files)
SELECT doc_id, len(list_filter(segments, lambda s: {IGNORE_ANY} OR regexp_full_match(s, '.*[.]lp.'))) > 0 OR list_contains(segments, 'bin')
  OR regexp_full_match(relative_path, 'src.*/gradle') OR regexp_full_match(relative_path, 'src1/.*[.]lock') AS ignored FROM parts""",
    "classified": f"WITH {CLASSIFIED} SELECT doc_id, artifact_type, ecosystem, parser, partial, status FROM gated",
    "artifact_counters": f"""WITH {CLASSIFIED} SELECT count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, count(*) FILTER (status = 'parsed') AS parsed,
  count(*) FILTER (status = 'partially parsed') AS partially_parsed, count(*) FILTER (status = 'detected but unsupported') AS unsupported, count(*) FILTER (status = 'failed') AS failed FROM gated""",
    "artifact_facets": f"WITH {CLASSIFIED} SELECT DISTINCT artifact_type AS value FROM gated WHERE artifact_type <> ''",
    "artifact_search": f"""WITH {CLASSIFIED} SELECT doc_id, relative_path, parser FROM gated WHERE status = 'partially parsed'
  AND contains(lower(relative_path || ' ' || artifact_type || ' ' || ecosystem || ' ' || status || ' ' || parser), 'lock') ORDER BY file_size DESC, relative_path DESC""",
    "normalized": f"""WITH {NORM} SELECT side, component_type, name, version, ecosystem, package_url, company_name, source_artifact, source_parser, dependency_scope, evidence, licenses, first_ordinal FROM norm""",
    "live_components": f"WITH {RAW} SELECT side, count(DISTINCT k) AS components, count(*) AS raw FROM keyed GROUP BY side",
    "compare_changes": f"WITH {COMPARED} SELECT * FROM changes",
    "compare_counts": f"""WITH {COMPARED} SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed,
  count(*) FILTER (kind = 'version_changed') AS version_changed, (SELECT CAST(sum(n_both) AS BIGINT) FROM per) AS unchanged FROM changes""",
    "compare_warnings": f"""WITH {COMPARED} SELECT DISTINCT * FROM (
  SELECT CASE n WHEN 1 THEN 'fallback' ELSE 'ambiguous' END AS kind, weak AS subject FROM weak WHERE missing AND n > 0
  UNION ALL SELECT 'fields-only', CAST(count(*) AS VARCHAR) FROM weak WHERE missing AND n = 0 HAVING count(*) > 0
  UNION ALL SELECT 'duplicate-' || side, identity || ' ' || version FROM vers WHERE n > 1)""",
    "compare_search": f"""WITH {COMPARED} SELECT row_key, name, before_version FROM changes WHERE kind = 'removed' AND contains(lower(kind || ' ' || name || ' ' || ecosystem || ' ' || component_type || ' ' ||
  before_version || ' ' || after_version || ' ' || before_package_url || ' ' || after_package_url || ' ' || before_scope || ' ' || after_scope || ' ' || identity_key), 'brand2')""",
    "change_lines": f"""WITH {COMPARED} SELECT row_key, CASE kind WHEN 'added' THEN '+ Added' WHEN 'removed' THEN '- Removed' ELSE '~ Changed' END || chr(9) || name || chr(9) || before_version || chr(9) ||
  after_version || chr(9) || ecosystem || chr(9) || component_type || chr(9) || identity_key AS line FROM changes""",
    "component_lines": f"""WITH {NORM}, {ADVISORIES}, issues AS (SELECT package_url, count(*) AS n FROM known GROUP BY 1)
SELECT first_ordinal, name || chr(9) || version || chr(9) || ecosystem || chr(9) || component_type || chr(9) || CASE s_suppkey % 4 WHEN 0 THEN chr(10003) || ' parsed' WHEN 1 THEN chr(9888) || ' partial'
  WHEN 2 THEN chr(9888) || ' unsupported' ELSE chr(10005) || ' failed' END || chr(9) || CASE WHEN i.n > 0 THEN chr(9888) || ' ' || i.n WHEN package_url = '' THEN 'Not queried' ELSE '0 observed' END ||
  chr(9) || replace(licenses, ',', '; ') || chr(9) || chr(9) || dependency_scope || chr(9) || source_artifact AS line
FROM norm LEFT JOIN issues i USING (package_url) JOIN supplier ON source_artifact = 'supplier-' || s_suppkey || '/manifest.json' WHERE side = 'current'""",
    "component_references": f"""WITH {NORM} SELECT first_ordinal, CASE WHEN package_url <> '' THEN package_url ELSE 'urn:ledgerline:component:' ||
  substr(sha256(lower(ecosystem) || chr(1) || lower(name) || chr(1) || version || chr(1) || lower(component_type)), 1, 32) END AS ref,
  CASE WHEN contains(dependency_scope, 'runtime') THEN '' WHEN contains(dependency_scope, 'optional') THEN 'optional' WHEN contains(dependency_scope, 'development') THEN 'excluded' ELSE '' END AS scope,
  '' AS requested, true AS exact FROM norm WHERE side = 'current'""",
    "component_view": f"""WITH {NORM}, {ADVISORIES}, issues AS (SELECT package_url, count(*) AS n FROM known GROUP BY 1)
SELECT first_ordinal, name, version, ['parsed', 'partially parsed', 'detected but unsupported', 'failed'][s_suppkey % 4 + 1] AS status, coalesce(i.n, 0) AS issues,
  CASE WHEN i.n > 0 THEN chr(9888) || ' ' || i.n WHEN package_url = '' THEN 'Not queried' ELSE '0 observed' END AS known_issues, replace(licenses, ',', '; ') AS licenses
FROM norm LEFT JOIN issues i USING (package_url) JOIN supplier ON source_artifact = 'supplier-' || s_suppkey || '/manifest.json'
WHERE side = 'current' AND ecosystem = 'npm' AND contains(name || ' ' || source_artifact, 'widget')""",
    "component_facets": f"WITH {RAW} SELECT DISTINCT ecosystem AS value FROM raw",
    "advisory_matches": f"WITH {RAW}, {ADVISORIES} SELECT * FROM known WHERE package_url IN (SELECT package_url FROM raw)",
    "scan_summary": f"""WITH {RAW}, {ADVISORIES}, m AS (SELECT * FROM known WHERE package_url IN (SELECT package_url FROM raw))
SELECT (SELECT count(*) FROM raw) AS components, (SELECT count(*) FROM raw WHERE package_url <> '') AS with_package_url, (SELECT count(*) FROM supplier) AS artifacts,
  (SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 3) AS failed_artifacts, (SELECT count(*) FROM m) AS matches, (SELECT count(DISTINCT advisory_id) FROM m) AS advisories""",
    "dependency_edges": f"WITH {REFS} SELECT * FROM edges",
    "dependency_sets": f"""WITH {REFS} SELECT owner_ref, count(dep_ref) AS n, sha256(coalesce(string_agg(dep_ref, ',' ORDER BY dep_ref), '')) AS digest FROM edges GROUP BY owner_ref""",
    "task_list": f"""WITH {TASKS} SELECT id, status, date_diff('millisecond', date_trunc('millisecond', lo), date_trunc('millisecond', hi)) AS duration_ms, warnings + errors + matches AS messages,
  status = 'completed' AND (warnings > 0 OR errors > 0 OR files_inspected = 0 OR matches > 0) AS needs_review, bytes_inspected,
  CASE WHEN needs_review THEN chr(9888) || ' completed with warnings' WHEN status = 'completed' THEN chr(10003) || ' completed' WHEN status = 'failed' THEN chr(10005) || ' failed'
    WHEN status = 'cancelled' THEN chr(9888) || ' cancelled' ELSE chr(8226) || ' ' || status END AS shown
  FROM tasks WHERE contains(lower(created_utc || ' ' || target_root_name || ' ' || status || ' ' || id), 'root-3')""",
    "previous_tasks": f"WITH {TASKS} SELECT id, lag(id) OVER (PARTITION BY target_root_name ORDER BY created_utc, id DESC) AS previous_id FROM tasks WHERE status = 'completed'",
    "initial_selection": f"""WITH {TASKS}, done AS (SELECT * FROM tasks WHERE status = 'completed'), newest AS (SELECT * FROM done ORDER BY created_utc DESC, id LIMIT 1)
SELECT n.id AS comparison_id, (SELECT d.id FROM done d WHERE d.id <> n.id ORDER BY d.target_root_name = n.target_root_name DESC, d.created_utc DESC, d.id LIMIT 1) AS baseline_id FROM newest n""",
    "strong_identities": f"""WITH picked AS ({_pick(package_url=STRONG)}),
q AS (SELECT *, regexp_extract(package_url, '#(.*)$', 1) AS sub, regexp_extract(package_url, '[?]([^#]*)', 1) AS qual, regexp_replace(package_url, '[?#].*$', '') AS rest FROM picked),
p AS (SELECT *, lower(regexp_extract(rest, '^[Pp][Kk][Gg]:/*([^/]+)', 1)) AS t, ltrim(regexp_replace(regexp_extract(rest, '^[Pp][Kk][Gg]:/*[^/]+/(.*)$', 1), '@[^@/]*$', ''), '/') AS path FROM q),
v AS (SELECT *, replace(replace(path, '%7e', '~'), '%41', 'A') AS clear,
    list_sort(list_transform(list_filter(string_split(qual, '&'), lambda x: x <> ''), lambda x: replace(x, '%41', 'A'))) AS quals FROM p)
SELECT id, package_url, CASE WHEN t = '' OR clear = '' OR len(list_filter(quals, lambda x: NOT contains(x, '='))) > 0 THEN ''
  ELSE 'purl:pkg:' || t || '/' || clear || CASE WHEN len(quals) > 0 THEN '?' || array_to_string(quals, '&') ELSE '' END || CASE WHEN sub <> '' THEN '#' || sub ELSE '' END END AS strong FROM v""",
    **formats.ORACLES,
    **strictness.ORACLES,
    **images.ORACLES,
    **surface.oracles(NORM, TASKS, PATHS),
}
