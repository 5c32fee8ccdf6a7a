"""Queries for path, unit and redaction functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from objcat.functions import paths, redact, units
from objcat.queries.fixtures import Registry

R = Registry()

PARTS = "list_filter(regexp_split_to_array(raw, '[/\\\\]'), lambda x: x <> '' AND x <> '.')"
CLEAN = f"CASE WHEN NOT list_contains({PARTS}, '..') THEN nfc_normalize(array_to_string({PARTS}, '/')) END"
WALK = f"""list_reduce(list_prepend('', {PARTS}), lambda acc, p: CASE WHEN acc = '!' THEN '!'
  WHEN p = '..' THEN CASE WHEN acc = '' THEN '!' ELSE regexp_replace(acc, '/[^/]*$', '') END ELSE acc || '/' || p END)"""


def _value(source: str, key: str, column):
    return lambda df: df.select(key, column().alias("v"))


def _simple(name: str, operator: str, source: str, key: str, column, sql: str) -> None:
    R.add(name, operator, source, _value(source, key, column), f"SELECT {key}, {sql} AS v FROM {{{source}}}")


_simple("path_nfc", "B1", "messy", "doc_id", lambda: paths.nfc("raw"), "nfc_normalize(raw)")
_simple("path_clean", "B2", "messy", "doc_id", lambda: paths.clean_path("raw"), CLEAN)
R.add(
    "path_parent_dir_use",
    "B3",
    "messy",
    lambda m: m.withColumn("u", paths.classify_parent_dir("raw")).select("doc_id", "u.kind", "u.resolved"),
    f"""SELECT doc_id, CASE WHEN list_contains({PARTS}, '..') THEN CASE WHEN {WALK} = '!' THEN 'escapes' ELSE 'inside' END END AS kind,
      CASE WHEN list_contains({PARTS}, '..') AND {WALK} <> '!' THEN nfc_normalize(ltrim({WALK}, '/')) END AS resolved
      FROM {{messy}}""",
)
R.add(
    "path_is_under",
    "B4",
    "inv_big",
    lambda i: i.select(
        "path", paths.is_under("A/F", "path").alias("a_f"), paths.is_under(F.split("path", "/")[0], "path").alias("own_top")
    ),
    """SELECT path, (path = 'A/F' OR starts_with(path, 'A/F/')) AS a_f,
      starts_with(path, split_part(path, '/', 1) || '/') AS own_top FROM {inv_big}""",
)
_simple("path_file_name", "B5", "messy", "doc_id", lambda: paths.file_name("raw"), "regexp_extract(raw, '[^/]*$')")
_simple(
    "path_parent", "B6", "messy", "doc_id", lambda: paths.parent("raw"), "CASE WHEN contains(raw, '/') THEN regexp_extract(raw, '^(.*)/[^/]*$', 1) ELSE '' END"
)
_simple(
    "path_join",
    "B7",
    "inv_src",
    "path",
    lambda: paths.join_path(F.when(F.length("path") % 2 == 0, paths.parent("path")).otherwise(""), paths.file_name("path")),
    """CASE WHEN length(path) % 2 = 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' ELSE '' END
      || regexp_extract(path, '[^/]*$')""",
)
_simple(
    "path_depth",
    "B8",
    "messy",
    "doc_id",
    lambda: paths.depth("raw").cast("long"),
    "len(list_filter(string_split(raw, '/'), lambda x: x <> ''))",
)
_simple(
    "path_ancestors",
    "B9",
    "inv_src",
    "path",
    lambda: F.array_join(paths.ancestors("path"), ","),
    """array_to_string(list_transform(range(len(string_split(path, '/'))),
      lambda n: array_to_string(string_split(path, '/')[1:n], '/')), ',')""",
)
_simple(
    "path_component_suffixes",
    "B10",
    "inv_src",
    "path",
    lambda: F.array_join(paths.component_suffixes("path"), ","),
    """array_to_string(list_transform(range(len(string_split(path, '/'))),
      lambda n: array_to_string(string_split(path, '/')[n + 1:], '/')), ',')""",
)
_simple(
    "path_relative_to",
    "B11",
    "inv_big",
    "path",
    lambda: paths.relative_to("A/F", "path"),
    "CASE WHEN starts_with(path, 'A/F/') THEN substr(path, 5) ELSE path END",
)
R.add(
    "path_problem",
    "B12",
    "messy",
    lambda m: m.select("doc_id", paths.path_problem("raw").alias("problem")),
    r"""SELECT doc_id, CASE WHEN raw = '' THEN 'empty' WHEN strlen(raw) > 4096 THEN 'too-long'
      WHEN starts_with(raw, '/') OR ends_with(raw, '/') THEN 'edge-separator'
      WHEN contains(raw, chr(92)) THEN 'backslash' WHEN regexp_matches(raw, '^[A-Za-z]:') THEN 'drive-letter'
      WHEN regexp_matches(raw, '(//|/\.\.?(/|$)|^\.\.?/)') THEN CASE
        WHEN regexp_matches(raw, '^([^/]+/)*?/') AND NOT regexp_matches(regexp_extract(raw, '^(.*?)//', 1), '(^|/)\.\.?(/|$)')
        THEN 'empty-segment' ELSE 'dot-segment' END END AS problem FROM {messy}""",
)
R.add(
    "path_logical_component",
    "B13",
    "messy",
    lambda m: m.withColumn(
        "n", F.when(F.col("doc_id") % 4 == 3, "..").otherwise(paths.file_name(F.concat("raw", F.lit("é"))))
    )
    .withColumn("c", paths.to_logical_component("n"))
    .select("doc_id", "c.name", "c.problem"),
    """WITH n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '..' ELSE regexp_extract(raw || 'é', '[^/]*$') END AS n FROM {messy})
      SELECT doc_id, CASE WHEN contains(n, chr(92)) OR n = '..' THEN NULL ELSE nfc_normalize(n) END AS name,
        CASE WHEN contains(n, chr(92)) THEN 'separator' WHEN n = '..' THEN 'parent-dir' END AS problem FROM n""",
)
R.add(
    "path_marker",
    "B14",
    "marked",
    lambda m: m.select("path", paths.is_marker("path").alias("marker"), paths.marker_path(paths.parent("path")).alias("own")),
    """SELECT path, regexp_extract(path, '[^/]*$') = '.objcat-dir' AS marker,
      regexp_extract(path, '^(.*/)?', 0) || '.objcat-dir' AS own FROM {marked}""",
)
_simple(
    "path_staging_key",
    "B15",
    "store_objects",
    "path",
    lambda: paths.is_staging_key("path"),
    "starts_with(regexp_extract(path, '[^/]*$'), '.objcat-staging.')",
)

SIZE_TEXT = """concat(CASE doc_id % 4 WHEN 0 THEN ' ' ELSE '' END, CASE WHEN doc_id % 17 = 0 THEN 'off' WHEN doc_id % 19 = 0 THEN '-5k'
  WHEN doc_id % 23 = 0 THEN '5 parsecs' WHEN doc_id % 29 = 0 THEN '1..5k' ELSE concat(CAST(n_chars AS STRING), '.5',
  CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'b' WHEN 2 THEN 'k' WHEN 3 THEN ' KiB' WHEN 4 THEN 'KB' WHEN 5 THEN 'Mi' WHEN 6 THEN 'MB'
    WHEN 7 THEN 'G' ELSE 'gb' END) END)"""
R.add(
    "size_parse",
    "C1",
    "documents",
    lambda d: d.withColumn("p", units.parse_size(F.expr(SIZE_TEXT))).select("doc_id", "p.bytes", "p.unlimited", "p.problem"),
    f"""WITH t AS (SELECT doc_id, trim({SIZE_TEXT}) AS t FROM {{documents}}),
      s AS (SELECT doc_id, t, regexp_extract(t, '^[0-9.]+') AS n, lower(trim(regexp_extract(t, '^[-0-9.]*(.*)$', 1))) AS u FROM t)
      SELECT doc_id, CASE WHEN t = 'off' OR starts_with(t, '-') OR contains(t, '..') OR u = 'parsecs' THEN NULL
        ELSE CAST(floor(CAST(n AS DOUBLE) * CASE u WHEN '' THEN 1 WHEN 'b' THEN 1 WHEN 'k' THEN 1024 WHEN 'kib' THEN 1024
          WHEN 'kb' THEN 1000 WHEN 'mi' THEN 1048576 WHEN 'mb' THEN 1000000 WHEN 'g' THEN 1073741824 ELSE 1000000000 END) AS BIGINT) END AS bytes,
        t = 'off' AS unlimited,
        CASE WHEN starts_with(t, '-') THEN 'negative' WHEN contains(t, '..') THEN 'invalid' WHEN u = 'parsecs' THEN 'unknown-suffix' END AS problem
      FROM s""",
)


def _printed(base: int, names: list[str]) -> str:
    cases = [f"WHEN size < {base} THEN size || ' {names[0]}'"]
    for power in range(1, len(names)):
        value = "size::DOUBLE" + f" / {base}" * power
        bound = f"WHEN {value} < {base} THEN " if power + 1 < len(names) else "ELSE "
        cases.append(f"{bound}CASE WHEN {value} < 10 THEN printf('%.2f', {value}) ELSE printf('%.1f', {value}) END || ' {names[power]}'")
    return f"CASE {' '.join(cases)} END"


R.add(
    "size_print",
    "C2",
    "inv_big",
    lambda i: i.select("path", units.format_bytes("size").alias("iec"), units.format_bytes(F.col("size") * 4099, "si").alias("si")),
    f"""SELECT path, {_printed(1024, units.IEC_UNITS)} AS iec, (SELECT {_printed(1000, units.SI_UNITS)} FROM (SELECT b.size * 4099 AS size)) AS si
      FROM {{inv_big}} AS b""",
)
AGE_TEXT = """CASE WHEN doc_id % 17 = 0 THEN 'OFF' WHEN doc_id % 19 = 0 THEN '-5d' WHEN doc_id % 23 = 0 THEN '5 fortnights' WHEN doc_id % 29 = 0 THEN '0h'
  ELSE concat(CAST(n_chars AS STRING), '.25', CASE doc_id % 9 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'h' WHEN 4 THEN 'd'
  WHEN 5 THEN 'w' WHEN 6 THEN 'M' WHEN 7 THEN 'y' ELSE '' END) END"""
R.add(
    "age_parse",
    "C3",
    "documents",
    lambda d: d.withColumn("p", units.parse_age(F.expr(AGE_TEXT))).select("doc_id", "p.seconds", "p.unlimited", "p.problem"),
    f"""WITH t AS (SELECT doc_id, {AGE_TEXT} AS t FROM {{documents}}),
      s AS (SELECT doc_id, t, regexp_extract(t, '^[0-9.]+') AS n, regexp_extract(t, '[a-zA-Z]*$') AS u FROM t)
      SELECT doc_id, CASE WHEN t IN ('OFF', '0h') OR starts_with(t, '-') OR u = 'fortnights' THEN NULL
        ELSE CAST(floor(CAST(n AS DOUBLE) * CASE u WHEN 'ms' THEN 0.001 WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400
          WHEN 'w' THEN 604800 WHEN 'M' THEN 2592000 WHEN 'y' THEN 31536000 ELSE 1 END) AS BIGINT) END AS seconds,
        t IN ('OFF', '0h') AS unlimited,
        CASE WHEN starts_with(t, '-') THEN 'negative' WHEN u = 'fortnights' THEN 'invalid' END AS problem FROM s""",
)
TIME_TEXT = """CASE doc_id % 7 WHEN 0 THEN 'now' WHEN 1 THEN concat('@', CAST(doc_id * 1000 AS STRING)) WHEN 2 THEN concat(CAST(n_chars AS STRING), 'h')
  WHEN 3 THEN concat('2024-02-', CAST(doc_id % 31 + 1 AS STRING)) WHEN 4 THEN concat('2023-11-05T07:', CAST(doc_id % 60 AS STRING), ':09Z')
  WHEN 5 THEN '1999-12-31 23:59:60.75+05:30' ELSE concat('not a time ', lang) END"""
R.add(
    "time_parse",
    "C4",
    "documents",
    lambda d: d.select("doc_id", units.parse_time(F.expr(TIME_TEXT), 1_700_000_000).alias("at")),
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 1700000000 WHEN 1 THEN doc_id * 1000 WHEN 2 THEN 1700000000 - n_chars * 3600
      WHEN 3 THEN CASE WHEN doc_id % 31 < 29 THEN 1706745600 + (doc_id % 31) * 86400 END
      WHEN 4 THEN epoch(TIMESTAMP '2023-11-05 07:00:09')::BIGINT + (doc_id % 60) * 60
      WHEN 5 THEN epoch(TIMESTAMP '2000-01-01 00:00:00')::BIGINT - 19800 END::BIGINT AS at FROM {documents}""",
)
_simple(
    "time_print",
    "C5",
    "inv_big",
    "path",
    lambda: units.rfc3339(F.col("mtime") * 977 - 2_000_000_000),
    "strftime(make_timestamp((mtime * 977 - 2000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ')",
)
R.add(
    "digest_form",
    "C6",
    "inv_src",
    lambda i: i.select(
        "path",
        units.is_hex_digest(F.sha2("hash", 256), "sha256").alias("sha256"),
        units.is_hex_digest(F.sha1("hash"), "blake3").alias("blake3"),
        units.is_hex_digest(F.concat(F.substring("hash", 1, 8), "hash", F.lit("g")).substr(1, 40), "sha1").alias("sha1"),
    ),
    """SELECT path, length(sha256(hash)) = 64 AS sha256, length(sha1(hash)) = 64 AS blake3,
      regexp_full_match(substr(concat(substr(hash, 1, 8), hash, 'g'), 1, 40), '[0-9a-f]{40}') AS sha1 FROM {inv_src}""",
)
_simple(
    "text_escape_controls",
    "C7",
    "documents",
    "doc_id",
    lambda: F.md5(redact.escape_controls(F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("\tend")).otherwise("")))),
    "md5(" + "replace(" * 6 + "text || CASE WHEN doc_id % 3 = 0 THEN chr(9) || 'end' ELSE '' END"
    + "".join(f", chr({c}), concat(chr(92), 'u{c:04x}'))" for c in (9, 10, 11, 12, 13, 27)) + ")",
)
WORDS = "|".join(w.replace("-", "[-]") for w in redact.SENSITIVE_WORDS)
QUERY_TEXT = "concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'Api_Key=', CAST(page_id AS STRING), '&x=1&tokens&=z')"
_simple(
    "url_redact",
    "C8",
    "pages",
    "page_id",
    lambda: redact.redact_url(F.expr(QUERY_TEXT)),
    f"""split_part({QUERY_TEXT}, '?', 1) || '?' || array_to_string(list_transform(string_split(regexp_extract({QUERY_TEXT}, '[?](.*)$', 1), '&'),
      lambda p: CASE WHEN contains(p, '=') AND regexp_matches(lower(split_part(p, '=', 1)), '{WORDS}') THEN split_part(p, '=', 1) || '=<redacted>' ELSE p END), '&')""",
)
_simple(
    "remote_redact",
    "C9",
    "aud",
    "path",
    lambda: redact.redact_remote("remote"),
    """concat('s3://sha256:', substr(sha256(regexp_extract(remote, '//([^@]*)@', 1)), 1, 8), '@', regexp_extract(remote, '@([^?]*)', 1), '?token=<redacted>&a=1')""",
)
