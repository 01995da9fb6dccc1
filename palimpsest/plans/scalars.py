"""Scalar functions (SC) over symbol names, signatures, paths and code texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import naming as N
from ..functions import scoring as S
from ..sources import parsers
from . import domain
from .domain import Tables
from .scans import _CODE


def _names(t: Tables):
    return t.symbols.where("name IS NOT NULL").select("name").distinct()


def _code(t: Tables):
    return t.documents.where(_CODE).select("doc_id", "text")


_IMPORTS = ["react", "@/x", "@org/p", "/abs/x", "./a", "../a/index", "./a.ts", "./a.svg", "lib/x", "a\\b", "../b/index.js"]


def _imports(t: Tables):
    """Import paths made of the fixture and the symbols' paths."""
    paths = t.symbols.where("path IS NOT NULL").select("path").distinct()
    forms = F.array(F.col("path"), F.concat(F.lit("./"), "path"), F.concat(F.lit("../"), F.regexp_replace("path", r"\.[a-z]+$", "/index")), F.concat(F.lit("@/"), "path"), F.concat(F.lit("/"), "path"), F.concat(F.lit("./"), "path", F.lit(".svg")), F.regexp_replace("path", "[/\\\\]", "-"))
    return paths.select(F.explode(forms).alias("p")).distinct()


_WS = r"[ \t\n\r\f\x0b]+"
_BODY = rf"trim(regexp_replace(regexp_replace(regexp_replace(text, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '{_WS}', ' ', 'g'))"
_SHAPE = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z_$][a-zA-Z0-9_$]*', 'ID', 'g'), '[0-9]+', 'NUM', 'g'), '(["''`])[^"''`]*["''`]', 'STR', 'g'), '{_WS}', '', 'g')"""
_SIG = rf"lower(regexp_replace(regexp_replace(signature, '[A-Za-z0-9_]+\s*:', ':', 'g'), '{_WS}', '', 'g'))"
_PARAMS = r"list_filter(list_transform(string_split(regexp_extract(signature, '\(([^)]*)\)', 1), ','), lambda p: trim(regexp_extract(trim(p), '^[^:=]*'))), lambda p: p <> '')"
_CONV = """CASE WHEN name = '' THEN 'unknown' WHEN regexp_matches(name, '^[a-z][^_A-Z-]*$') THEN 'camelCase' WHEN contains(name, '_') AND name = upper(name) THEN 'SCREAMING_SNAKE'
 WHEN contains(name, '_') AND NOT regexp_matches(name, '[A-Z]') THEN 'snake_case' WHEN contains(name, '-') AND NOT regexp_matches(name, '[A-Z]') THEN 'kebab-case' WHEN contains(name, '_') THEN 'mixed'
 WHEN regexp_matches(name, '^[A-Z]') THEN 'PascalCase' WHEN regexp_matches(name, '^[a-z]') AND regexp_matches(name, '[A-Z]') THEN 'camelCase' ELSE 'unknown' END"""
_PARTS = "list_filter(regexp_split_to_array(lower(CASE WHEN name = upper(name) THEN name ELSE regexp_replace(name, '([A-Z])', '_\\1', 'g') END), '[_-]'), lambda x: x <> '')"
_NAMES = ", n AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL) "
_SIGS = ", g AS (SELECT DISTINCT signature FROM symbols WHERE signature IS NOT NULL) "
_CODES = f", code AS (SELECT doc_id, text FROM documents WHERE {_CODE}) "
_BASE = "regexp_extract(replace(path, chr(92), '/'), '[^/]*$')"
_HASH = "list_reduce(list_transform(list_filter(string_split(name, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT))"

STYLES = rf""", f AS (SELECT DISTINCT path, regexp_replace({_BASE}, '(.)\.[^.]*$', '\1') AS s, regexp_extract(regexp_extract(replace(path, chr(92), '/'), '^(.*)/[^/]*$', 1), '[^/]*$') AS d FROM symbols WHERE path IS NOT NULL),
styled AS (SELECT path, CASE WHEN contains(s, '_') AND s = upper(s) THEN 'SCREAMING_SNAKE' WHEN contains(s, '_') AND NOT regexp_matches(s, '[A-Z]') THEN 'snake_case' WHEN contains(s, '-') AND NOT regexp_matches(s, '[A-Z]') THEN 'kebab-case' WHEN regexp_matches(s, '^[A-Z]') THEN 'PascalCase' WHEN regexp_matches(s, '[A-Z]') THEN 'camelCase'
WHEN contains(d, '_') AND NOT contains(d, '-') THEN 'snake_case' WHEN contains(d, '-') AND NOT contains(d, '_') THEN 'kebab-case' ELSE 'camelCase' END AS style FROM f) """


def _fact_dna(t: Tables):
    """Identity of structural facts from kind, name, level, shape of the signature and length of the timeline; damaged facts have none."""
    rows = t.hybrid_facts.select("id", F.try_parse_json("serialized_fact").alias("v"), F.coalesce(F.json_array_length(F.when(F.try_parse_json("timeline_json").isNotNull(), F.col("timeline_json"))), F.lit(0)).alias("n")).where(F.schema_of_variant("v").startswith("OBJECT"))
    part = {c: F.coalesce(F.try_variant_get("v", f"$.{c}", "string"), F.lit("")) for c in ("kind", "name", "level", "signature")}
    return rows.select("id", H.digest(F.concat_ws("::", part["kind"], part["name"], part["level"], H.shape(part["signature"]), F.col("n").cast("string")), 16).alias("dna")).distinct()


def _fingerprints(t: Tables):
    """Fingerprints of versions of facts, and of bundles: all facts of a version, told as JSON with keys in a fixed order."""
    facts = t.hybrid_facts.select("id", "file_path", "version", "fact_id").distinct()
    one = facts.select(F.lit("version").alias("scope"), F.col("id").cast("string").alias("key"), H.digest(F.concat_ws(":", "file_path", "version", "fact_id")).alias("fingerprint"))
    bundle = facts.where("version IS NOT NULL").groupBy("version").agg(F.count(F.lit(1)).alias("facts"), F.min("id").alias("first"), F.max("id").alias("last"))
    return one.unionByName(bundle.select(F.lit("bundle").alias("scope"), F.col("version").alias("key"), H.digest(F.to_json(F.struct("version", "facts", "first", "last"))).alias("fingerprint")))


def _canonical(t: Tables):
    """Fingerprints of JSON whose keys came in another order: of an object with nested ones, and of an array."""
    rows = t.commits_analysis.where("risks IS NOT NULL AND symbols_removed IS NOT NULL AND edges_added IS NOT NULL AND edges_removed IS NOT NULL")
    mixed = F.to_json(F.struct(F.col("symbols_removed").alias("z"), F.from_json("risks", "array<string>").alias("r"), F.struct(F.col("edges_added").alias("y"), F.col("edges_removed").alias("x")).alias("a")))
    return rows.select("sha", H.digest(H.canonical_json(mixed), 16).alias("nested"), H.digest(H.canonical_json(F.col("risks")), 16).alias("list")).distinct()


def _lower_hash(t: Tables):
    return _names(t).select("name", H.rolling_hash(F.col("name")).alias("h"))


QUERIES = domain.catalogue(
    {
        "SC-01": (
            lambda t: _names(t).select("name", N.convention(F.col("name")).alias("convention"), N.confidence(F.col("name")).alias("confidence"), F.array_join(N.parts(F.col("name")), " ").alias("parts")),
            _NAMES + f"SELECT name, {_CONV} AS convention, CASE WHEN name = '' THEN 0.0 WHEN regexp_matches(name, '^[a-z][^_A-Z-]*$') OR ({_CONV}) = 'mixed' THEN 0.7 WHEN ({_CONV}) = 'unknown' THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence, array_to_string({_PARTS}, ' ') AS parts FROM n",
        ),
        "SC-02": (
            lambda t: _names(t).select("name", *(N.renamed(F.col("name"), c).alias(a) for c, a in (("camelCase", "camel"), ("PascalCase", "pascal"), ("snake_case", "snake"), ("SCREAMING_SNAKE", "scream"), ("kebab-case", "kebab")))),
            _NAMES + f", p AS (SELECT name, {_PARTS} AS w FROM n), q AS (SELECT name, w, list_transform(w, lambda x: upper(x[1]) || x[2:]) AS c FROM p) SELECT name, CASE WHEN len(w) = 0 THEN name ELSE w[1] || array_to_string(c[2:], '') END AS camel, CASE WHEN len(w) = 0 THEN name ELSE array_to_string(c, '') END AS pascal, CASE WHEN len(w) = 0 THEN name ELSE array_to_string(w, '_') END AS snake, CASE WHEN len(w) = 0 THEN name ELSE upper(array_to_string(w, '_')) END AS scream, CASE WHEN len(w) = 0 THEN name ELSE array_to_string(w, '-') END AS kebab FROM q",
        ),
        "SC-03": (
            lambda t: _imports(t).select("p", N.import_style(F.col("p")).alias("style")),
            rf""", b AS (SELECT DISTINCT path FROM symbols WHERE path IS NOT NULL), i AS (SELECT DISTINCT unnest([path, './' || path, '../' || regexp_replace(path, '\.[a-z]+$', '/index'), '@/' || path, '/' || path, './' || path || '.svg', regexp_replace(path, '[/\\]', '-', 'g')]) AS p FROM b)
            SELECT p, CASE WHEN NOT regexp_matches(p, '[/\\]') THEN 'package' WHEN starts_with(p, '@/') THEN 'alias' WHEN starts_with(p, '@') THEN 'package' WHEN starts_with(p, '/') THEN 'absolute'
            WHEN regexp_matches(p, '^\.\.?/') AND regexp_matches(p, '/index(\.js|\.ts)?$') THEN 'index' WHEN regexp_matches(p, '^\.\.?/') AND regexp_extract(regexp_extract(p, '[^/]*$'), '.\.([^./]*)$', 1) NOT IN ('', {", ".join(repr(x) for x in parsers.EXTENSIONS)}) THEN 'extension'
            WHEN regexp_matches(p, '^\.\.?/') THEN 'no-extension' ELSE 'relative' END AS style FROM i""",
        ),
        "SC-04": (
            lambda t: t.symbols.where("path IS NOT NULL").select("path").distinct().select("path", N.file_style(F.col("path")).alias("style")),
            STYLES + "SELECT path, style FROM styled",
        ),
        "SC-05": (lambda t: t.symbols.where("signature IS NOT NULL").select("signature").distinct().select("signature", F.array_join(N.parameters(F.col("signature")), ",").alias("params")), _SIGS + f"SELECT signature, array_to_string({_PARAMS}, ',') AS params FROM g"),
        "SC-06": (
            lambda t: t.symbols.where("signature IS NOT NULL").select("signature").distinct().select("signature", N.return_convention(F.col("signature")).alias("style")),
            _SIGS + r"SELECT signature, CASE WHEN contains(signature, 'Promise<') OR contains(signature, ': Promise') THEN 'promise' WHEN contains(signature, 'async') THEN 'async' WHEN contains(signature, 'callback') OR contains(signature, 'cb') OR regexp_matches(signature, '\(.*\)\s*=>') THEN 'callback' WHEN regexp_matches(signature, ':\s*[A-Z][a-zA-Z0-9<>\[\]]+') THEN 'sync' ELSE 'unknown' END AS style FROM g",
        ),
        "SC-07": (lambda t: _code(t).select("doc_id", H.body_hash(F.col("text")).alias("body_hash")), _CODES + f"SELECT doc_id, sha256({_BODY})[1:16] AS body_hash FROM code"),
        "SC-08": (lambda t: _code(t).select("doc_id", H.shape_hash(F.col("text")).alias("shape_hash")), _CODES + f"SELECT doc_id, sha256({_SHAPE})[1:8] AS shape_hash FROM code"),
        "SC-09": (lambda t: t.symbols.where("signature IS NOT NULL").select("signature").distinct().select("signature", H.normal_signature(F.col("signature")).alias("normal")), _SIGS + f"SELECT signature, {_SIG} AS normal FROM g"),
        "SC-10": (lambda t: t.symbols.where("signature IS NOT NULL AND kind IS NOT NULL").select("id", H.symbol_dna(F.col("kind"), F.col("signature")).alias("dna")).distinct(), f"SELECT DISTINCT id, sha256(kind || '::' || {_SIG})[1:16] AS dna FROM symbols WHERE signature IS NOT NULL AND kind IS NOT NULL"),
        "SC-11": (
            lambda t: _names(t).select("name", N.parts(F.col("name")).alias("w")).select("name", F.array_join(H.ngrams(F.col("w")), "|").alias("grams"), H.ngram_fingerprint(F.col("w")).alias("fingerprint")),
            _NAMES + f", p AS (SELECT name, {_PARTS} AS w FROM n), q AS (SELECT name, list_sort(list_distinct(list_concat(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ',')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ','))))) AS g FROM p) SELECT name, array_to_string(g, '|') AS grams, sha256(array_to_string(list_transform(g, lambda x: x || ':1'), '|'))[1:12] AS fingerprint FROM q",
        ),
        "SC-12": (
            _fact_dna,
            f""", v AS (SELECT DISTINCT id, serialized_fact AS j, CASE WHEN json_valid(timeline_json) AND json_type(timeline_json) = 'ARRAY' THEN json_array_length(timeline_json) ELSE 0 END AS n FROM hybrid_facts WHERE json_valid(serialized_fact) AND json_type(serialized_fact) = 'OBJECT'),
            p AS (SELECT id, coalesce(json_extract_string(j, '$.kind'), '') AS kind, coalesce(json_extract_string(j, '$.name'), '') AS name, coalesce(json_extract_string(j, '$.level'), '') AS level, coalesce(json_extract_string(j, '$.signature'), '') AS signature, n FROM v)
            SELECT id, sha256(kind || '::' || name || '::' || level || '::' || {_SHAPE.replace('text', 'signature')} || '::' || n)[1:16] AS dna FROM p""",
        ),
        "SC-13": (
            lambda t: t.symbol_versions.where("body_hash IS NOT NULL AND path IS NOT NULL").groupBy("path").agg(H.set_hash(F.collect_set(F.lower("body_hash"))).alias("hash")),
            "SELECT path, sha256(string_agg(DISTINCT lower(body_hash), '|' ORDER BY lower(body_hash)))[1:16] AS hash FROM symbol_versions WHERE body_hash IS NOT NULL AND path IS NOT NULL GROUP BY path",
        ),
        "SC-14": (
            _fingerprints,
            """, f AS (SELECT DISTINCT id, file_path, version, fact_id FROM hybrid_facts) SELECT 'version' AS scope, CAST(id AS VARCHAR) AS key, sha256(concat_ws(':', file_path, version, fact_id)) AS fingerprint FROM f
            UNION ALL SELECT 'bundle', version, sha256('{"version":"' || version || '","facts":' || count(*) || ',"first":' || min(id) || ',"last":' || max(id) || '}') FROM f WHERE version IS NOT NULL GROUP BY version""",
        ),
        "SC-15": (
            _canonical,
            """, v AS (SELECT DISTINCT sha, symbols_removed AS z, edges_added AS y, edges_removed AS x, CAST(CAST(risks AS JSON) AS VARCHAR[]) AS l FROM commits_analysis WHERE risks IS NOT NULL AND symbols_removed IS NOT NULL AND edges_added IS NOT NULL AND edges_removed IS NOT NULL)
            SELECT sha, sha256('{"a":{"x":' || x || ',"y":' || y || '},"r":' || CASE WHEN len(l) = 0 THEN '[]' ELSE '["' || array_to_string(l, '","') || '"]' END || ',"z":' || z || '}')[1:16] AS nested, sha256(CASE WHEN len(l) = 0 THEN '[]' ELSE '["' || array_to_string(list_sort(l), '","') || '"]' END)[1:16] AS list FROM v""",
        ),
        "SC-16": (
            lambda t: t.documents.where("repo IS NOT NULL").groupBy("repo").agg(H.set_hash(F.collect_set(F.sha2("text", 256))).alias("workspace_hash")),
            "SELECT repo, sha256(string_agg(DISTINCT sha256(text), '|' ORDER BY sha256(text)))[1:16] AS workspace_hash FROM documents WHERE repo IS NOT NULL GROUP BY repo",
        ),
        "SC-17": (_lower_hash, _NAMES + f"SELECT name, greatest({_HASH}, 1) AS h FROM n"),
        "SC-18": (
            lambda t: _names(t).select("name", F.posexplode(H.hash_embedding(F.col("name"), 4)).alias("i", "v")).select("name", "i", F.round("v", 6).alias("v")),
            _NAMES + f", h AS (SELECT name, greatest({_HASH}, 1) AS h FROM n), s AS (SELECT name, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h, unnest(range(4)) AS i FROM h) SELECT name, CAST(i AS INT) AS i, round(sin((h + i) * 0.01::DOUBLE) * 0.5 + 0.5, 6) AS v FROM s",
        ),
        "SC-19": (
            lambda t: t.symbols.where("name IS NOT NULL").select(F.concat(F.when(F.col("kind") == "method", "method_").otherwise("function_"), F.coalesce("path", F.lit("x")), F.lit(":a."), F.col("name"), F.lit("()")).alias("raw")).distinct().select("raw", H.callee_name(F.col("raw")).alias("callee")),
            ", r AS (SELECT DISTINCT (CASE WHEN kind = 'method' THEN 'method_' ELSE 'function_' END) || coalesce(path, 'x') || ':a.' || name || '()' AS raw FROM symbols WHERE name IS NOT NULL) SELECT raw, regexp_replace(list_extract(regexp_split_to_array(regexp_replace(raw, '^(?:function|method)_', ''), '[:.\\s]'), -1), '[^A-Za-z0-9_]', '', 'g') AS callee FROM r",
        ),
        "SC-20": (
            lambda t: t.symbols.where("symbol_id IS NOT NULL").select("symbol_id").distinct().select("symbol_id", H.edge_dna(F.col("symbol_id")).alias("dna")),
            "SELECT DISTINCT symbol_id, CASE WHEN starts_with(symbol_id, 'unknown:') THEN NULL ELSE regexp_extract(symbol_id, '[^:]*$') END AS dna FROM symbols WHERE symbol_id IS NOT NULL",
        ),
        "SC-21": (
            lambda t: t.edge.select(F.format_string("p%s -> s%s (%s)", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("edge_type")).alias("text")).select("text", H.edge_parts(F.col("text")).alias("x")).select("text", "x.src", "x.dst", "x.edge_type"),
            "SELECT 'p' || src || ' -> s' || dst || ' (' || edge_type || ')' AS text, 'p' || src AS src, 's' || dst AS dst, edge_type FROM edge",
        ),
        "SC-22": (
            lambda t: t.symbols.where("path IS NOT NULL").select("path").distinct().select("path", N.basename(F.col("path")).alias("base"), N.dirname(F.col("path")).alias("dir"), N.extension(F.col("path")).alias("ext")),
            rf"SELECT DISTINCT path, {_BASE} AS base, regexp_extract(replace(path, chr(92), '/'), '^(.*)/[^/]*$', 1) AS dir, lower(regexp_extract({_BASE}, '.\.([^.]*)$', 1)) AS ext FROM symbols WHERE path IS NOT NULL",
        ),
        "SC-23": (
            lambda t: _code(t).select("doc_id", H.line_slice(F.col("text"), F.lit(5) - 3, F.least(F.lit(8) + 3, F.lit(5) + 9)).alias("snippet")),
            _CODES + "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:11], chr(10)) AS snippet FROM code",
        ),
        "SC-24": (
            lambda t: _code(t).select("doc_id", H.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("body")),
            _CODES + "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS body FROM code",
        ),
        "SC-25": (
            lambda t: t.documents.where("text IS NOT NULL").select("doc_id", H.token_estimate(F.col("text")).alias("tokens")),
            "SELECT doc_id, CAST(ceil(length(text) / CASE WHEN (length(text) - length(regexp_replace(text, '[{}\\[\\]();=<>]', '', 'g'))) / greatest(length(text), 1) > 0.1 THEN 3.5 ELSE 4.0 END) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL",
        ),
        "SC-26": (
            lambda t: t.commit.select("sha", F.round(S.recency(F.col("date"), F.lit("1999-01-01").cast("timestamp")), 6).alias("recency"), F.round(F.least(F.lit(100.0), F.log10(1 + 9 * (F.col("size") % 1)) * 100), 6).alias("compressed")),
            "SELECT sha, round(exp(-(epoch_us(TIMESTAMP '1999-01-01') - epoch_us(date)) / 86400000000.0 / 30), 6) AS recency, round(least(100.0, log10(1 + 9 * (size % 1)) * 100), 6) AS compressed FROM commit",
        ),
        "SC-27": (
            lambda t: t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.from_json("props", "k long")).alias("again")),
            """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS again FROM events""",
        ),
        "SC-28": (
            lambda t: t.commits_analysis.where("analysis_version IS NOT NULL").select("analysis_version").distinct().select("analysis_version", (H.version_key(F.col("analysis_version")) >= F.array(F.lit(2), F.lit(0), F.lit(0), F.lit(0))).alias("is_current")),
            "SELECT DISTINCT analysis_version, (list_transform(string_split(analysis_version, '.'), lambda x: coalesce(try_cast(x AS INT), 0)) || [0, 0, 0, 0])[1:4] >= [2, 0, 0, 0] AS is_current FROM commits_analysis WHERE analysis_version IS NOT NULL",
        ),
        "SC-29": (
            lambda t: t.commits_analysis.select("sha", F.array_join(F.filter(F.array(F.when(F.col("blast_radius") > 20, "wide"), F.when(F.lower("status") == "complete", "done"), F.when(F.col("symbols_removed") > 0, "removal")), lambda x: x.isNotNull()), ",").alias("tags")).distinct(),
            "SELECT DISTINCT sha, concat_ws(',', CASE WHEN blast_radius > 20 THEN 'wide' END, CASE WHEN lower(status) = 'complete' THEN 'done' END, CASE WHEN symbols_removed > 0 THEN 'removal' END) AS tags FROM commits_analysis",
        ),
        "SC-30": (
            lambda t: t.symbols.select("id", F.format_string("%s %s in %s", F.coalesce("kind", F.lit("symbol")), F.coalesce("name", F.lit("?")), F.coalesce("path", F.lit("?"))).alias("shard")).distinct(),
            "SELECT DISTINCT id, coalesce(kind, 'symbol') || ' ' || coalesce(name, '?') || ' in ' || coalesce(path, '?') AS shard FROM symbols",
        ),
        "SC-31": (
            lambda t: t.symbols.where("name IS NOT NULL").select("id", N.well_named(F.col("name"), F.col("kind")).alias("good")).distinct(),
            "SELECT DISTINCT id, CASE WHEN kind IN ('function', 'method') THEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') WHEN kind = 'class' THEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') ELSE true END AS good FROM symbols WHERE name IS NOT NULL",
        ),
        "SC-32": (
            lambda t: t.symbols.where("name IS NOT NULL").select("id", (F.col("name").rlike(S.OLD_NAMESPACE) | F.coalesce(F.col("path").rlike(S.OLD_NAMESPACE), F.lit(False))).alias("old")).distinct(),
            f"SELECT DISTINCT id, regexp_matches(name, '{S.OLD_NAMESPACE}') OR coalesce(regexp_matches(path, '{S.OLD_NAMESPACE}'), false) AS old FROM symbols WHERE name IS NOT NULL",
        ),
    }
)
