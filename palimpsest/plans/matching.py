"""Similarity and scores (SM, HS)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import naming as N
from ..functions import scoring as S
from ..functions import similarity as M
from ..operators import hotspots, moves
from ..operators import relational as R
from ..sources import parsers
from . import domain
from .domain import Tables
from .scalars import _SHAPE, _SIG
from .scans import _CODE


def _pairs(t: Tables):
    """Removed and added symbols of one commit and kind, lined up by name: as many pairs as the shorter side has."""
    sha = F.lower(F.btrim("sha")).alias("sha")
    rows = t.symbols.where("name IS NOT NULL AND signature IS NOT NULL")
    old = rows.where("change_type = 'removed'").select(sha, "kind", F.col("id").alias("a"), F.col("name").alias("an"), F.col("signature").alias("sa"), F.col("path").alias("pa")).distinct()
    new = rows.where("change_type = 'added'").select(sha, "kind", F.col("id").alias("b"), F.col("name").alias("bn"), F.col("signature").alias("sb"), F.col("path").alias("pb")).distinct()

    def place(df, name: str, key: str):
        return df.withColumn("k", F.row_number().over(W.partitionBy("sha", "kind").orderBy(name, key)))

    return place(old, "an", "a").join(place(new, "bn", "b"), ["sha", "kind", "k"])


def _replacement_pairs(t: Tables):
    """Removed and added symbols of one commit and kind: as many pairs as a commit's two sides have."""
    sha = F.lower(F.btrim("sha")).alias("sha")
    rows = t.symbols.where("name IS NOT NULL AND signature IS NOT NULL AND path IS NOT NULL")
    old = rows.where("change_type = 'removed'").select(sha, "kind", F.col("id").alias("a"), F.col("name").alias("an"), F.col("signature").alias("sa"), F.col("path").alias("pa")).distinct()
    new = rows.where("change_type = 'added'").select(sha, "kind", F.col("id").alias("b"), F.col("name").alias("bn"), F.col("signature").alias("sb"), F.col("path").alias("pb")).distinct()
    return old.join(new, ["sha", "kind"])


def _moved(t: Tables):
    """Removed and added symbols of one commit, kind and name with the confidence of a move above 0.7: nothing else can reach it."""
    sha = F.lower(F.btrim("sha")).alias("sha")
    rows = t.symbols.where("name IS NOT NULL AND signature IS NOT NULL")

    def side(kind: str, i: str, s: str, p: str):
        return rows.where(F.col("change_type").isin(kind, "moved")).select(sha, "kind", "name", F.col("id").alias(i), F.col("signature").alias(s), N.extension(F.col("path")).alias(p)).distinct()

    met = side("removed", "a", "sa", "la").join(side("added", "b", "sb", "lb"), ["sha", "kind", "name"]).where("a <> b")
    return met.select("a", "b", F.round(M.move((F.col("name"), F.col("name")), (F.col("kind"), F.col("kind")), (F.col("sa"), F.col("sb")), (F.col("la"), F.col("lb"))), 6).alias("confidence")).where("confidence > 0.7")


_PAIRS = """, o AS (SELECT DISTINCT lower(trim(sha)) AS sha, kind, id AS a, name AS an, signature AS sa, path AS pa FROM symbols WHERE change_type = 'removed' AND name IS NOT NULL AND signature IS NOT NULL),
n AS (SELECT DISTINCT lower(trim(sha)) AS sha, kind, id AS b, name AS bn, signature AS sb, path AS pb FROM symbols WHERE change_type = 'added' AND name IS NOT NULL AND signature IS NOT NULL), ok AS (SELECT *, row_number() OVER (PARTITION BY sha, kind ORDER BY an, a) AS k FROM o), nk AS (SELECT *, row_number() OVER (PARTITION BY sha, kind ORDER BY bn, b) AS k FROM n), pr AS (SELECT * FROM ok JOIN nk USING (sha, kind, k)) """
_EXT = "lower(regexp_extract(regexp_extract(replace(path, chr(92), '/'), '[^/]*$'), '.\\.([^.]*)$', 1))"


def _edit(a: str, b: str) -> str:
    return f"(greatest(length({a}), length({b})) - levenshtein({a}, {b})) / greatest(length({a}), length({b}), 1)::DOUBLE"


def _dice(a: str, b: str) -> str:
    def grams(x: str) -> str:
        return f"list_distinct(list_transform(range(1, length({x})), lambda i: {x}[i:i+1]))"

    return f"CASE WHEN len({grams(a)}) + len({grams(b)}) = 0 THEN 1.0 ELSE 2 * len(list_intersect({grams(a)}, {grams(b)})) / (len({grams(a)}) + len({grams(b)})) END::DOUBLE"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({x}, '[^A-Za-z0-9_]+'), lambda w: w <> ''))"


def _params(x: str) -> str:
    return f"len(list_filter(string_split(regexp_extract({x}, '\\(([^)]*)\\)', 1), ','), lambda p: trim(p) <> ''))"


def _versions(t: Tables):
    """Versions of a symbol in order: dna, position, id, name, path."""
    rows = t.symbol_versions.where("dna_id IS NOT NULL").select(F.lower("dna_id").alias("dna"), "id", "name", "path", "load_batch").distinct()
    return rows


def _moves(t: Tables):
    """Blocks of code found again: equal text, or text of equal shape, in any other document of a language."""
    code = t.documents.where(_CODE).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "file_path", "text")
    return moves.candidates(code, "lang", 0.6)


_MOVES = f""", c AS (SELECT doc_id, coalesce(lang, '') AS lang, file_path, text, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '/\\*[\\s\\S]*?\\*/', '', 'g'), '//[^\\n]*', '', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS h, sha256({_SHAPE}) AS s FROM documents WHERE {_CODE}),
rep AS (SELECT *, regexp_extract(file_path, '[^/]*$') AS fname FROM c WHERE file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang, h, fname ORDER BY doc_id) = 1),
near AS (SELECT a.lang, a.h, a.fname, b.doc_id AS b, b.file_path AS target, CASE WHEN greatest(length(a.text), length(b.text)) > 2000 THEN {_dice("a.text", "b.text")} ELSE {_edit("a.text", "b.text")} END::DOUBLE AS score FROM rep a JOIN rep b ON a.lang = b.lang AND a.s = b.s AND a.fname = b.fname AND a.h <> b.h),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, a.file_path AS source, b.file_path AS target, 1.0::DOUBLE AS score FROM c a JOIN c b ON a.lang = b.lang AND a.h = b.h AND a.doc_id <> b.doc_id
  UNION ALL SELECT c.doc_id, b, c.file_path, target, score FROM c JOIN near ON c.lang = near.lang AND c.h = near.h AND regexp_extract(c.file_path, '[^/]*$') = near.fname WHERE score >= 0.6),
m AS (SELECT a, b, source, target, round(score, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score, 6) DESC, b) = 1) """


# No SQL for the similarities of whole texts: DuckDB's edit distance counts bytes, not characters.


def _lineage(t: Tables):
    return moves.lineage(t.symbols.select(F.lower("dna_id").alias("dna"), "id", "name", "path", "change_type", F.col("load_batch").alias("pos")).where("dna IS NOT NULL").distinct())


def _clusters(t: Tables):
    return moves.name_clusters(t.symbols.where("name IS NOT NULL AND kind IS NOT NULL").select("kind", F.array_join(F.array_sort(N.parts(F.col("name"))), " ").alias("words")).distinct(), 0.8)


def _divergent(t: Tables):
    return moves.divergent(t.symbols.where("dna_id IS NOT NULL AND name IS NOT NULL").select(F.lower(F.btrim("dna_id")).alias("dna"), "name").distinct(), 0.7)


def _file_metrics(t: Tables):
    return hotspots.file_metrics(t.change.join(t.commit, "sha"), "path", "sha", "author", "date", F.lit(domain.AS_OF).cast("timestamp"), t.commit.count())


_FILE_METRICS = f""", j AS (SELECT path, sha, author, date FROM change JOIN commit USING (sha)), u AS (SELECT DISTINCT path, sha, date FROM j),
gap AS (SELECT path, (epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY path ORDER BY date, sha)) / 86400000000.0 AS g FROM u),
b AS (SELECT path, least(1.0, coalesce(stddev_pop(g) / nullif(avg(g), 0) / 2, 0.0)) AS burstiness FROM gap GROUP BY path),
f AS (SELECT path, count(DISTINCT sha) AS n, count(*) AS changes, count(DISTINCT author) AS authors, max(date) AS last FROM j GROUP BY path),
m AS (SELECT path, least(1.0, n / sqrt((SELECT count(*) FROM commit))) AS frequency, exp(-(epoch_us(TIMESTAMP '{domain.AS_OF}') - epoch_us(last)) / 86400000000.0 / 30) AS recency, least(1.0, authors / 5) AS author_diversity, least(1.0, changes / n / 10) AS intensity, burstiness FROM f JOIN b USING (path)),
h AS (SELECT path, least(100.0, log10(1 + 9 * (frequency * 0.35 + recency * 0.2 + author_diversity * 0.15 + intensity * 0.2 + burstiness * 0.1)) * 100)::DOUBLE AS score FROM m) """

_LEVEL = "CASE WHEN {0} >= 80 THEN 'critical' WHEN {0} >= 60 THEN 'high' WHEN {0} >= 40 THEN 'medium' ELSE 'low' END"


def _scored(t: Tables):
    return hotspots.scored(_file_metrics(t)).select("path", "score")


def _risk(t: Tables):
    rows = t.symbols.where("sha IS NOT NULL").select(F.lower(F.btrim("sha")).alias("sha"), "path", "name", "kind", "change_type", "mod_reason", "id").distinct()
    flags = [F.max(S.risk_flag(f, F.col("path"), F.col("name"))).alias(f) for f in ("schema-migration", "security", "performance", "auth", "payment")]
    breaking = F.max(F.coalesce(F.col("kind").isin("function", "method") & (F.col("mod_reason") == "signature_changed") & ~F.col("name").startswith("_"), F.lit(False)) | F.coalesce((F.col("change_type") == "removed") & ~F.col("name").startswith("_"), F.lit(False)))
    per = rows.groupBy("sha").agg(*flags, breaking.alias("breaking-api"), ((F.countDistinct("path") > 10) | (F.countDistinct(F.when(F.col("change_type") == "renamed", F.col("id"))) > 5) | (F.countDistinct("id") > 20)).alias("refactor"))
    names = ["breaking-api", "schema-migration", "refactor", "security", "performance", "auth", "payment"]
    return per.select("sha", F.array_join(F.array_compact(F.array(*(F.when(F.col(f"`{n}`"), n) for n in names))), ",").alias("risks"))


def _risk_sql() -> str:
    def flag(f: str) -> str:
        return f"bool_or(coalesce(regexp_matches(path, '(?i){S.RISK_WORDS[f]}'), false) OR coalesce(regexp_matches(name, '(?i){S.RISK_WORDS[f]}'), false))"

    return f""", r AS (SELECT DISTINCT lower(trim(sha)) AS sha, path, name, kind, change_type, mod_reason, id FROM symbols WHERE sha IS NOT NULL)
    SELECT sha, concat_ws(',', CASE WHEN bool_or(coalesce(kind IN ('function', 'method') AND mod_reason = 'signature_changed' AND NOT starts_with(name, '_'), false) OR coalesce(change_type = 'removed' AND NOT starts_with(name, '_'), false)) THEN 'breaking-api' END,
    CASE WHEN {flag("schema-migration")} THEN 'schema-migration' END, CASE WHEN count(DISTINCT path) > 10 OR count(DISTINCT id) FILTER (change_type = 'renamed') > 5 OR count(DISTINCT id) > 20 THEN 'refactor' END, CASE WHEN {flag("security")} THEN 'security' END, CASE WHEN {flag("performance")} THEN 'performance' END, CASE WHEN {flag("auth")} THEN 'auth' END, CASE WHEN {flag("payment")} THEN 'payment' END) AS risks FROM r GROUP BY sha"""


def _diff_scan(t: Tables):
    rows = parsers.lines(t.documents, "doc_id")
    line = F.col("line")
    return rows.groupBy("doc_id").agg(F.count_if(line.rlike(r"^@@ -\d+,?\d* \+\d+,?\d* @@")).alias("hunks"), F.count_if(line.startswith("+") & ~line.startswith("+++")).alias("added"), F.count_if(line.startswith("-") & ~line.startswith("---")).alias("removed"), F.count_if(line.rlike(S.CONTROL_FLOW)).alias("control_flow"), F.count_if(line.rlike(S.INTERFACE)).alias("interface"))


_HIGHLIGHTS = rf""", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) FILTER (regexp_matches(line, '^@@ -\d+,?\d* \+\d+,?\d* @@')) AS hunks, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS added, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS removed,
count(*) FILTER (regexp_matches(line, '{S.CONTROL_FLOW}')) AS control_flow, count(*) FILTER (regexp_matches(line, '{S.INTERFACE}')) AS interface FROM l GROUP BY doc_id"""


def _node_metrics(t: Tables):
    churn = t.file.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    drift = t.change.groupBy("path").agg(F.round(100 * F.count_if(F.col("change_type") == "removed") / F.count(F.lit(1)), 6).alias("pct"))
    fan = t.edge.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("fan_in"))
    rows = churn.join(drift, "path").join(fan, "path", "left").na.fill(0, ["fan_in"])
    c, d = F.least(F.lit(100.0), F.col("n") / 50 * 100), F.ceil(F.col("pct") / 10)
    return rows.select("path", F.round(c, 4).alias("churn"), d.alias("drift"), "fan_in", F.least(F.lit(100), F.floor(0.4 * c + 10 * d + 0.5 * F.col("fan_in") + 0.5)).alias("risk"))


def _impact(t: Tables):
    changed = t.change.where("kind = 'O' AND change_type = 'added'").select("path").distinct()
    ten = changed.select("path", F.lit(10).alias("w"))
    down = t.edge.join(changed, F.col("src") == F.col("path"), "left_semi").select(F.col("dst").alias("path"), F.lit(5).alias("w"))
    up = t.edge.join(changed, F.col("dst") == F.col("path"), "left_semi").select(F.col("src").alias("path"), F.lit(3).alias("w"))
    return ten.unionByName(down).unionByName(up).groupBy("path").agg(F.sum("w").alias("impact"))


QUERIES = domain.catalogue(
    {
        "SM-01": (lambda t: _pairs(t).select("a", "b", F.levenshtein("an", "bn").alias("distance")), _PAIRS + "SELECT a, b, levenshtein(an, bn) AS distance FROM pr"),
        "SM-02": (lambda t: _pairs(t).select("a", "b", F.round(M.edit(F.col("an"), F.col("bn")), 6).alias("similarity")), _PAIRS + f"SELECT a, b, round({_edit('an', 'bn')}, 6) AS similarity FROM pr"),
        "SM-03": (lambda t: _pairs(t).select("a", "b", F.round(M.dice(F.col("sa"), F.col("sb")), 6).alias("similarity")), _PAIRS + f"SELECT a, b, round({_dice('sa', 'sb')}, 6) AS similarity FROM pr"),
        "SM-04": (lambda t: _pairs(t).select("a", "b", F.round(M.text(F.repeat("sa", 40), F.repeat("sb", 40)), 6).alias("similarity")), _PAIRS + f", rr AS (SELECT a, b, repeat(sa, 40) AS x, repeat(sb, 40) AS y FROM pr) SELECT a, b, round(CASE WHEN greatest(length(x), length(y)) > 2000 THEN {_dice('x', 'y')} ELSE {_edit('x', 'y')} END, 6) AS similarity FROM rr"),
        "SM-05": (lambda t: _pairs(t).select("a", "b", F.round(M.jaccard(F.col("sa"), F.col("sb")), 6).alias("similarity")), _PAIRS + f"SELECT a, b, round(CASE WHEN len({_words('sa')}) = 0 OR len({_words('sb')}) = 0 THEN 0.0 ELSE len(list_intersect({_words('sa')}, {_words('sb')})) / len(list_distinct(list_concat({_words('sa')}, {_words('sb')}))) END::DOUBLE, 6) AS similarity FROM pr"),
        "SM-06": (lambda t: _pairs(t).where("an <> bn").select("a", "b", F.round(M.edit(F.lower("an"), F.lower("bn")), 6).alias("similarity")), _PAIRS + f"SELECT a, b, round({_edit('lower(an)', 'lower(bn)')}, 6) AS similarity FROM pr WHERE an <> bn"),
        "SM-07": (
            lambda t: _pairs(t).select("a", "b", F.round(M.rename((F.col("kind"), F.col("kind")), (F.col("sa"), F.col("sb")), (F.col("an"), F.col("bn"))), 6).alias("confidence")),
            _PAIRS + f"SELECT a, b, round(least(1.0, 0.3 + CASE WHEN {_SIG.replace('signature', 'sa')} = {_SIG.replace('signature', 'sb')} THEN 0.4 ELSE 0.0 END + CASE WHEN an <> bn THEN 0.3 * {_edit('an', 'bn')} ELSE 0.0 END)::DOUBLE, 6) AS confidence FROM pr",
        ),
        "SM-08": (
            _moved,
            f""", r AS (SELECT DISTINCT lower(trim(sha)) AS sha, kind, name, id, signature, {_EXT} AS ext, change_type FROM symbols WHERE name IS NOT NULL AND signature IS NOT NULL),
            p AS (SELECT DISTINCT o.id AS a, n.id AS b, o.signature AS sa, n.signature AS sb, o.ext AS la, n.ext AS lb FROM r o JOIN r n USING (sha, kind, name) WHERE o.change_type IN ('removed', 'moved') AND n.change_type IN ('added', 'moved') AND o.id <> n.id),
            k AS (SELECT a, b, round(0.5 + CASE WHEN sa = sb THEN 0.4 WHEN {_edit('sa', 'sb')} > 0.8 THEN 0.3 ELSE 0.0 END + CASE WHEN la = lb THEN 0.1 ELSE 0.0 END, 6)::DOUBLE AS confidence FROM p) SELECT * FROM k WHERE confidence > 0.7""",
        ),
        "SM-09": (
            lambda t: moves.replacements(_replacement_pairs(t)),
            f""", o AS (SELECT DISTINCT lower(trim(sha)) AS sha, kind, id AS a, name AS an, signature AS sa, path AS pa FROM symbols WHERE change_type = 'removed' AND name IS NOT NULL AND signature IS NOT NULL AND path IS NOT NULL),
            n AS (SELECT DISTINCT lower(trim(sha)) AS sha, kind, id AS b, name AS bn, signature AS sb, path AS pb FROM symbols WHERE change_type = 'added' AND name IS NOT NULL AND signature IS NOT NULL AND path IS NOT NULL),
            pr AS (SELECT *, {_params('sa')} AS qa, {_params('sb')} AS qb, regexp_extract(pa, '^(.*/)?', 1) AS da, regexp_extract(pb, '^(.*/)?', 1) AS db FROM o JOIN n USING (sha, kind)),
            s AS (SELECT a, b, round((1.5 + CASE WHEN an = bn THEN 2.5 ELSE 2 * {_edit('an', 'bn')} END + 1 + CASE WHEN pa = pb THEN 1.0 WHEN da = db THEN 0.8 ELSE 0.5 END
            + CASE WHEN sa = sb THEN 2.0 WHEN qa = qb THEN 1.5 ELSE 1 + 0.5 * least(qa, qb) / greatest(qa, qb, 1) END)::DOUBLE / 8, 6) AS score FROM pr),
            k AS (SELECT *, lead(score) OVER (PARTITION BY a ORDER BY score DESC, b) AS second, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM s WHERE score > 0.6) SELECT a, b, score FROM k WHERE rn = 1 AND (second IS NULL OR score > round(second + 0.2, 6))""",
        ),
        "SM-10": (
            lambda t: t.symbol_versions.where("path IS NOT NULL").groupBy(F.lower("dna_id").alias("dna")).agg(F.min("path").alias("p"), F.max("path").alias("q")).select("dna", F.round(M.path(F.col("p"), F.col("q")), 6).alias("similarity")),
            ", x AS (SELECT lower(dna_id) AS dna, string_split(min(path), '/') AS p, string_split(max(path), '/') AS q FROM symbol_versions WHERE path IS NOT NULL GROUP BY 1), y AS (SELECT dna, greatest(len(p), len(q)) AS m, list_position(list_transform(range(1, greatest(len(p), len(q)) + 1), lambda i: coalesce(p[i] = q[i], false)), false) AS f FROM x) SELECT dna, round(CASE WHEN f IS NULL OR f = 0 THEN m ELSE f - 1 END / m::DOUBLE, 6) AS similarity FROM y",
        ),
        "SM-11": (lambda t: _moves(t).select("a", "b", "score"), None),
        "SM-12": (lambda t: _moves(t).where("source IS NOT NULL AND target IS NOT NULL").select("a", "b", M.move_reason(F.col("source"), F.col("target"), F.col("score")).alias("reason")), None),
        "SM-13": (lambda t: _moves(t).where("a <> b").select(F.col("b").alias("symbol_id"), F.col("a").alias("previous_symbol_id"), F.lit("symbol_rename").alias("move_type")), None),
        "SM-14": (
            _lineage,
            """, s AS (SELECT DISTINCT lower(dna_id) AS dna, id, name, path, change_type, load_batch AS pos FROM symbols WHERE dna_id IS NOT NULL)
            SELECT a.id AS old_id, b.id AS new_id, CASE WHEN a.name IS DISTINCT FROM b.name THEN 'rename' WHEN a.path IS DISTINCT FROM b.path THEN 'relocate' ELSE 'refactor' END AS move_type FROM s a JOIN s b ON a.dna = b.dna AND b.pos = a.pos + 1 WHERE a.change_type = 'removed' AND b.change_type = 'added'""",
        ),
        "SM-15": (lambda t: _moves(t).where("source = target OR score = 1").select("a", "b", "source", "score").orderBy(F.col("score").desc(), "a"), _MOVES + "SELECT a, b, source, score FROM m WHERE source = target OR score = 1"),
        "SM-16": (_clusters, None),
        "SM-17": (
            _divergent,
            f""", n AS (SELECT DISTINCT lower(trim(dna_id)) AS dna, name FROM symbols WHERE dna_id IS NOT NULL AND name IS NOT NULL), p AS (SELECT a.dna, avg({_edit('a.name', 'b.name')}) AS s, count(*) AS pairs FROM n a JOIN n b ON a.dna = b.dna AND a.name < b.name GROUP BY a.dna)
            SELECT dna, round(s, 6) AS mean_similarity, s > 0.9 AS consolidate FROM p WHERE round(s, 6) > 0.7""",
        ),
        "HS-01": (lambda t: _scored(t).select("path", F.round("score", 4).alias("score")), _FILE_METRICS + "SELECT path, round(score, 4) AS score FROM h"),
        "HS-02": (lambda t: _scored(t).groupBy(S.risk_level(F.col("score")).alias("level")).agg(F.count(F.lit(1)).alias("files")), _FILE_METRICS + f"SELECT {_LEVEL.format('score')} AS level, count(*) AS files FROM h GROUP BY 1"),
        "HS-03": (
            lambda t: _file_metrics(t).select("path", *(F.round(c, 6).alias(c) for c in ("frequency", "recency", "author_diversity", "intensity"))),
            _FILE_METRICS + "SELECT path, round(frequency, 6)::DOUBLE AS frequency, round(recency, 6) AS recency, round(author_diversity, 6)::DOUBLE AS author_diversity, round(intensity, 6)::DOUBLE AS intensity FROM m",
        ),
        "HS-04": (
            lambda t: t.change.groupBy("symbol_id").agg(F.countDistinct("sha").alias("n")).select("symbol_id", F.lit(0.5).alias("authors"), F.least(F.lit(1.0), F.col("n") / 20).alias("intensity")),
            "SELECT symbol_id, 0.5::DOUBLE AS authors, least(1.0::DOUBLE, count(DISTINCT sha) / 20) AS intensity FROM change GROUP BY symbol_id",
        ),
        "HS-05": (
            lambda t: hotspots.burstiness(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id"), "user_id", "ts", "event_id").select("user_id", F.round("burstiness", 6).alias("burstiness")),
            ", g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 86400000000.0 AS g FROM events) SELECT user_id, round(least(1.0::DOUBLE, coalesce(stddev_pop(g) / nullif(avg(g), 0) / 2, 0.0)), 6) AS burstiness FROM g GROUP BY user_id",
        ),
        "HS-06": (
            lambda t: t.change.groupBy("path").agg(F.sum(F.when(F.col("kind") == "F", F.col("lines")).otherwise(0)).alias("old"), F.sum("lines").alias("new")).where((F.col("old") > 0) & (F.abs(F.col("new") - F.col("old")) / F.greatest("old", F.lit(1)) >= 0.05)).select("path", "new"),
            "SELECT path, sum(lines) AS new FROM change GROUP BY path HAVING sum(CASE WHEN kind = 'F' THEN lines ELSE 0 END) > 0 AND abs(sum(lines) - sum(CASE WHEN kind = 'F' THEN lines ELSE 0 END)) / greatest(sum(CASE WHEN kind = 'F' THEN lines ELSE 0 END), 1) >= 0.05",
        ),
        "HS-07": (
            lambda t: _scored(t).select("path", F.round("score", 4).alias("score")).orderBy(F.col("score").desc(), "path").limit(20),
            _FILE_METRICS + "SELECT path, round(score, 4) AS score FROM h ORDER BY 2 DESC, path LIMIT 20",
        ),
        "HS-08": (
            lambda t: t.change.join(t.commit.where(F.col("date") >= F.lit("1998-01-01").cast("timestamp")), "sha").groupBy("path", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("changes")).orderBy("path", "month"),
            "SELECT path, strftime(date, '%Y-%m') AS month, count(*) AS changes FROM change JOIN commit USING (sha) WHERE date >= TIMESTAMP '1998-01-01' GROUP BY ALL",
        ),
        "HS-09": (
            lambda t: R.first_n(t.change.join(t.commit, "sha").groupBy(F.date_format("date", "yyyy").alias("year"), "path").agg(F.count(F.lit(1)).alias("changes")), 1000, ["year"], F.col("changes").desc(), F.col("path")),
            "SELECT strftime(date, '%Y') AS year, path, count(*) AS changes FROM change JOIN commit USING (sha) GROUP BY year, path QUALIFY row_number() OVER (PARTITION BY year ORDER BY changes DESC, path) <= 1000",
        ),
        "HS-10": (
            lambda t: t.symbol_versions.where("path IS NOT NULL").groupBy("path").agg(F.countDistinct("load_batch").alias("k")).withColumn("n", t.symbol_versions.agg(F.countDistinct("load_batch")).scalar()).select("path", F.format_string("%d/%d versions", "k", "n").alias("touched")),
            "SELECT path, count(DISTINCT load_batch) || '/' || (SELECT count(DISTINCT load_batch) FROM symbol_versions) || ' versions' AS touched FROM symbol_versions WHERE path IS NOT NULL GROUP BY path",
        ),
        "HS-11": (
            _node_metrics,
            """, c AS (SELECT path, count(*) AS n FROM file GROUP BY path), d AS (SELECT path, round(100 * count(*) FILTER (change_type = 'removed') / count(*), 6) AS pct FROM change GROUP BY path), f AS (SELECT dst AS path, count(DISTINCT src) AS fan_in FROM edge GROUP BY dst),
            x AS (SELECT path, least(100.0, n / 50 * 100)::DOUBLE AS churn, CAST(ceil(pct / 10) AS BIGINT) AS drift, coalesce(fan_in, 0) AS fan_in FROM c JOIN d USING (path) LEFT JOIN f USING (path)) SELECT path, round(churn, 4) AS churn, drift, fan_in, CAST(least(100, floor(0.4::DOUBLE * churn + 10 * drift + 0.5::DOUBLE * fan_in + 0.5::DOUBLE)) AS BIGINT) AS risk FROM x""",
        ),
        "HS-12": (
            lambda t: t.commits_analysis.select("sha", F.round(S.health(F.col("symbols_removed"), F.col("symbols_added") + F.col("symbols_modified"), F.col("edges_removed"), F.col("symbols_removed")), 6).alias("health")).distinct(),
            "SELECT DISTINCT sha, round(least(greatest(greatest(0.0, 100 - 100 * coalesce(symbols_removed / nullif(symbols_added + symbols_modified, 0), 0.0)) - 2 * edges_removed - 0.5::DOUBLE * symbols_removed, 0.0), 100.0)::DOUBLE, 6) AS health FROM commits_analysis",
        ),
        "HS-13": (
            lambda t: t.commits_analysis.select("sha", F.round(F.greatest(S.structural_change(F.col("symbols_modified") + F.col("symbols_added"), F.col("edges_added")), 0.1 * F.col("symbols_removed")), 6).alias("structural")).distinct(),
            "SELECT DISTINCT sha, round(greatest(least(least((symbols_modified + symbols_added) / 10, 1.0) * (1 + least(edges_added / greatest(symbols_modified + symbols_added, 1), 1.0)), 1.0), 0.1::DOUBLE * symbols_removed)::DOUBLE, 6) AS structural FROM commits_analysis",
        ),
        "HS-14": (_diff_scan, _HIGHLIGHTS),
        "HS-15": (_risk, _risk_sql()),
        "HS-16": (
            lambda t: t.symbols.where("change_type = 'modified'").groupBy(S.change_class(F.coalesce(F.col("mod_reason") == "signature_changed", F.lit(False)), F.coalesce(F.col("mod_reason") == "visibility_changed", F.lit(False)), F.coalesce(F.col("mod_reason") == "doc_changed", F.lit(False))).alias("class")).agg(F.countDistinct("id").alias("symbols")),
            "SELECT CASE mod_reason WHEN 'signature_changed' THEN 'signature' WHEN 'visibility_changed' THEN 'visibility' WHEN 'doc_changed' THEN 'annotation' ELSE 'body' END AS class, count(DISTINCT id) AS symbols FROM symbols WHERE change_type = 'modified' GROUP BY 1",
        ),
        "HS-17": (
            _impact,
            ", c AS (SELECT DISTINCT path FROM change WHERE kind = 'O' AND change_type = 'added') SELECT path, CAST(sum(w) AS BIGINT) AS impact FROM (SELECT path, 10 AS w FROM c UNION ALL SELECT dst, 5 FROM edge WHERE src IN (SELECT path FROM c) UNION ALL SELECT src, 3 FROM edge WHERE dst IN (SELECT path FROM c)) GROUP BY path",
        ),
        "HS-18": (
            lambda t: t.edge.select("src", "dst", "edge_type", S.edge_confidence(F.when(F.col("edge_type") == "O", "calls").otherwise("imports"), F.col("confidence") > 0.95).alias("confidence")).withColumn("is_resolved", F.col("confidence") > 0.5),
            "SELECT src, dst, edge_type, CASE WHEN edge_type <> 'O' THEN 0.9 WHEN confidence > 0.95 THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence, edge_type <> 'O' OR confidence > 0.95 AS is_resolved FROM edge",
        ),
        "HS-19": (
            lambda t: t.edge.groupBy("src").agg(F.count(F.lit(1)).alias("n")).select("src", S.edge_threshold(F.col("n")).alias("threshold")),
            "SELECT src, CASE WHEN count(*) < 50 THEN 0.4 ELSE 0.7 END::DOUBLE AS threshold FROM edge GROUP BY src",
        ),
    }
)
