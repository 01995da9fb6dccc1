"""Retrieval, streaming, view derivations and control tables (VE, STR, VW, SP)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import naming as N
from ..functions import scoring as S
from ..functions.keys import norm_path
from ..operators import drift as D
from ..operators import relational as R
from ..operators import upserts, vector
from ..session import Cut
from ..sources import parsers
from ..streaming import live
from . import domain, drifting, matching
from .domain import Tables


def _vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def _queries(t: Tables):
    """The query set: every row whose id is divisible by 100."""
    return _vectors(t).where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vector")


def _hits(t: Tables, k: int = 10, least: float = 0.0):
    return vector.top_k(_queries(t), _vectors(t), k, least)


SIM = """, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
sims AS (SELECT query_id, item_id, label, round(list_cosine_similarity(q.v, e.v), 6) AS similarity FROM q, e WHERE query_id <> item_id),
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank_no FROM sims WHERE similarity >= 0) """


def _labels(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("item_id"), "label")


def _centroid_hits(t: Tables):
    seeds = R.first_n(_vectors(t).select(F.col("label").cast("long").alias("query_id"), "item_id", "vector"), 5, ["query_id"], F.col("item_id"))
    seeds = Cut(t.spark, "seeds").put(seeds)[1]
    hits = vector.top_k(vector.centroids(seeds, "query_id"), _vectors(t).join(F.broadcast(seeds.select("item_id")), "item_id", "left_anti"), 10, -1.0, exclude_self=False)  # five seeds a label
    return hits.select(F.col("query_id").alias("label"), "item_id", "similarity")


CENTROID = """, sd AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5), ct AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(v[i]) AS x FROM sd, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
cs AS (SELECT ct.label, vec_id AS item_id, round(list_cosine_similarity(ct.v, CAST(embedding AS DOUBLE[])), 6) AS similarity FROM ct, embeddings WHERE vec_id NOT IN (SELECT vec_id FROM sd))
SELECT label, item_id, similarity FROM cs QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, item_id) <= 10"""


def _reranked(t: Tables):
    """Hits of two indexes together, boosted where an item's label is among the three most frequent, differs from the query's, or is near it."""
    both = vector.top_k(_queries(t), _vectors(t).where("label < 5"), 10, 0.0).unionByName(vector.top_k(_queries(t), _vectors(t).where("label >= 5"), 10, 0.0))
    hot = F.broadcast(t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label").limit(3).select("label", F.lit(True).alias("hot")))
    own = _labels(t).withColumnsRenamed({"item_id": "query_id", "label": "own"})
    tagged = both.join(_labels(t), "item_id").join(own, "query_id").join(hot, "label", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    ranked = vector.rerank(tagged, (F.col("hot"), 1.3), (F.col("label") != F.col("own"), 1.2), (F.abs(F.col("label") - F.col("own")) <= 1, 1.1))
    return ranked.select("query_id", "item_id", F.round("score", 6).alias("score"))


def _stream(t: Tables):
    return live.edit_stream(t.spark, t.where)


def _watched(t: Tables):
    """Commits of a stream, each key once: bursts are debounced, and what earlier batches indexed is skipped."""
    path = f"{Cut(t.spark, 'watched').base}/commits"

    def apply(batch, n: int):
        rows = live.bursts(batch, "250 milliseconds").groupBy("entity").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("ts"))
        earlier = [f"{path}/{k}" for k in live.written(t.spark, path) if k < n]
        if earlier:
            rows = live.fresh(rows, t.spark.read.parquet(*earlier), ["entity"])
        live.put_batch(rows, path, n)

    live.run_batches(_stream(t), apply)
    return t.spark.read.parquet(*(f"{path}/{k}" for k in live.written(t.spark, path))).groupBy("entity").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def _queue(t: Tables):
    """Upserts of a stream, flushed per micro-batch in files of at most 1000 rows: the last value of every key over all batches."""
    path = f"{Cut(t.spark, 'queue').base}/rows"
    live.run_batches(_stream(t), lambda batch, n: live.put_batch(upserts.upsert(batch.select("entity", "ts", "event_id"), ["entity"], "ts"), path, n, flush_rows=1000))
    return upserts.upsert(t.spark.read.parquet(*(f"{path}/{k}" for k in live.written(t.spark, path))), ["entity"], "ts").select("entity", "event_id")


def _range_join(t: Tables):
    """Lines of code files against the ranges of their symbols: newest ten commits of each symbol."""
    lines = parsers.lines(t.documents.where("file_path IS NOT NULL AND sha IS NOT NULL"), "file_path", "doc_id", "sha").select("file_path", "line_no", "sha", "doc_id")
    ranges = t.documents.where("file_path IS NOT NULL").groupBy("file_path").agg(F.min("doc_id").alias("symbol"), F.lit(2).alias("first"), F.lit(6).alias("last"))
    met = lines.join(ranges, "file_path").where(F.col("line_no").between(F.col("first"), F.col("last")))
    per = met.groupBy("symbol", "sha").agg(F.max("doc_id").alias("doc_id"))
    return R.first_n(per, 10, ["symbol"], F.col("doc_id").desc(), F.col("sha")).select("symbol", "sha")


def _symbol_lineage(t: Tables):
    """Lineage seen from either end, with the symbol's place on the timeline."""
    steps = matching._lineage(t)
    ends = steps.withColumn("symbol_id", F.col("old_id")).unionByName(steps.withColumn("symbol_id", F.col("new_id")))
    at = t.symbols.select(F.col("id").alias("symbol_id"), F.col("load_batch").alias("pos")).distinct()
    return ends.join(at, "symbol_id").select("symbol_id", "old_id", "new_id", "move_type", "pos").orderBy("symbol_id", "pos")


def _counts(t: Tables):
    """Evidence per category: entries of arrays, keys of objects; null where the value is damaged or of another kind."""

    def whole(c: str):
        return F.when(F.try_parse_json(c).isNotNull(), F.col(c))

    rows = t.commits_analysis.select("sha", *(whole(c).alias(c) for c in ("risks", "hotspots_json", "raw_llm_json"))).distinct()
    return rows.select("sha", F.json_array_length("risks").alias("risks"), F.json_array_length("hotspots_json").alias("hotspots"), F.size(F.json_object_keys("raw_llm_json")).alias("sections"))


def _cached_reports(t: Tables):
    """Lookup by fingerprint: every row whose id 100 divides asks which rows have its fingerprint."""
    prints = t.hybrid_facts.select("id", H.digest(F.concat_ws(":", "file_path", "version")).alias("fingerprint")).distinct()
    return prints.where("id % 100 = 0").select(F.col("id").alias("query_id"), "fingerprint").join(prints, "fingerprint").select("query_id", "id", "fingerprint")


def _debt(t: Tables):
    """Missing and zombie symbols, dead nodes and left-over callees, as one sum."""
    drift = D.symbol_drift(drifting._want(t), drifting._have(t))
    left = t.edge.join(t.change.where("change_type = 'removed'").select(F.col("symbol_id").alias("dst")).distinct(), "dst", "left_semi")
    out = drift.agg(F.count_if(F.col("drift") == "missing").alias("missing"), F.count_if(F.col("drift") == "zombie").alias("zombies"))
    out = out.withColumn("dead", drifting._dead(t).agg(F.count(F.lit(1))).scalar()).withColumn("leftovers", left.agg(F.countDistinct("dst")).scalar())
    return out.withColumn("debt", F.col("missing") + F.col("zombies") + F.col("dead") + F.col("leftovers"))


def _folders(t: Tables):
    """Folders of two levels: files, symbols, files with a risk word, and the sum of the files' greatest finite impact scores."""
    path = norm_path(F.col("path"))
    sym = t.symbols.where("path IS NOT NULL").select(path.alias("path"), "id").distinct()
    per = sym.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))
    hot = t.symbol_history.where("file_path IS NOT NULL AND impact_score IS NOT NULL AND NOT isnan(impact_score) AND abs(impact_score) < double('infinity')").groupBy(norm_path(F.col("file_path")).alias("path")).agg(F.max("impact_score").alias("score"))
    risky = F.lit(False)
    for flag in S.RISK_WORDS:
        risky = risky | S.risk_flag(flag, F.col("path"))
    rows = per.join(hot, "path", "left").select(F.substring_index("path", "/", 2).alias("folder"), "symbols", risky.alias("risky"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols"), F.count_if("risky").alias("risks"), F.round(F.sum("score"), 4).alias("score"))


def _versions(t: Tables):
    """The timeline: position of each load batch of the symbol versions."""
    return t.symbol_versions.select("load_batch").distinct().withColumn("pos", F.row_number().over(W.orderBy("load_batch")) - 1)  # one row per load


def _prefixes(t: Tables):
    parts = F.split(norm_path(F.col("path")), "/")
    rows = t.files.where("path IS NOT NULL").select(parts.alias("p")).distinct()
    each = rows.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    joined = each.select(F.array_join(F.slice("p", 1, F.col("n")), "/").alias("id"), F.element_at("p", F.col("n")).alias("name"), F.when(F.col("n") > 1, F.array_join(F.expr("slice(p, 1, greatest(n - 1, 0))"), "/")).alias("parent"), (F.col("n") == F.size("p")).alias("is_file"))
    return joined.groupBy("id", "name", "parent").agg(F.max("is_file").alias("is_file"))


_NPATH = "regexp_replace(regexp_replace(replace(path, chr(92), '/'), '/+', '/', 'g'), '^(\\./)+', '')"


def _rollup(t: Tables):
    sym = t.symbols.where("path IS NOT NULL").select(F.substring_index(norm_path(F.col("path")), "/", 2).alias("folder"), "path", "id", "confidence").distinct()
    return sym.groupBy("folder").agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("symbols"), F.round(F.sum("confidence"), 4).alias("score"))


def _actions(t: Tables):
    d = F.col("message")
    rows = t.commits_metadata.where("message IS NOT NULL").select("message").distinct()
    return rows.select("message", S.keyword_level(d, S.PRIORITY, "low").alias("priority"), S.keyword_level(d, S.EFFORT, "xs").alias("effort"), S.keyword_level(d, S.RISK, "low").alias("risk"))


def _levels_sql(levels, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{'|'.join(words)}') THEN '{level}'" for level, words in levels) + f" ELSE '{otherwise}' END"


ACTIONS = f""", ac AS (SELECT DISTINCT message, {_levels_sql(S.PRIORITY, "low")} AS priority, {_levels_sql(S.EFFORT, "xs")} AS effort, {_levels_sql(S.RISK, "low")} AS risk FROM commits_metadata WHERE message IS NOT NULL) """


def _weights(**levels):
    return F.create_map(*(F.lit(x) for pair in levels.items() for x in pair))


def _top_actions(t: Tables):
    score = _weights(urgent=10, high=5, medium=2, low=1)[F.col("priority")] * _weights(xs=5, s=4, m=3, l=2, xl=1)[F.col("effort")] * _weights(low=1.5, medium=1.0, high=0.7)[F.col("risk")]
    return _actions(t).withColumn("score", F.round(score, 4)).orderBy(F.col("score").desc(), "message").limit(5).select("message", "score")


def _age(c):
    days = F.floor((F.unix_micros(F.lit(domain.AS_OF).cast("timestamp")) - F.unix_micros(c)) / 86_400_000_000.0)
    return (
        F.when(c.isNull(), "Unknown").when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).when(days < 30, F.concat(F.floor(days / 7).cast("string"), F.lit(" weeks ago")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago"))).otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit(" years ago")))
    )


def _glob(pattern: str) -> str:
    """Regular expression of a glob: ``**`` crosses directories, ``*`` does not."""
    import re

    return "^" + "".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.split(r"(\*\*|\*)", pattern)) + "$"


def _skeleton(t: Tables):
    p = norm_path(F.col("path"))
    return t.files.where("path IS NOT NULL").select(p.alias("path")).distinct().where((F.col("path") == "src") | F.col("path").startswith("src/")).where(~F.col("path").rlike(_glob("src/core/**")) & ~F.col("path").rlike(_glob("src/*/edge*/*")))


LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "php": "php", "py": "python", "go": "go", "css": "css", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml"}


def _languages(t: Tables):
    known = t.spark.createDataFrame(list(LANGUAGES.items()), "ext string, language string")
    paths = t.files.where("path IS NOT NULL").select("path").distinct().withColumn("ext", N.extension(F.col("path")))
    return paths.join(F.broadcast(known), "ext", "left").select("path", F.coalesce("language", F.lit("unknown")).alias("language"), F.col("language").isin("markdown", "json", "yaml", "css").alias("structural_only"))


def _status(t: Tables):
    rows = upserts.latest(t.commits_analysis.select(F.lower(F.btrim("sha")).alias("sha"), F.lower("status").alias("status"), "analysis_version", F.col("analyzed_at").cast("timestamp").alias("analyzed_at")), ["sha"], F.col("analyzed_at").desc_nulls_last(), F.col("status"), F.col("analysis_version"))
    done = rows.where(F.col("status").isin("complete") & (H.version_key(F.col("analysis_version")) >= F.array(F.lit(2), F.lit(0), F.lit(0), F.lit(0))))
    return rows.join(done, "sha", "left_anti").select("sha", "status")


def _gaps(t: Tables):
    expected = {"symbols": ["id", "sha", "path", "dna_id", "convention_confidence"], "files": ["id", "sha", "path", "size"], "symbol_versions": ["id", "dna_id", "body_hash"]}
    rows = [(name, c) for name, columns in expected.items() for c in columns if c not in getattr(t, name).schema.names]
    return t.spark.createDataFrame(rows, "table_name string, missing string")


QUERIES = domain.catalogue(
    {
        "VE-01": (lambda t: _hits(t, 10, 0.3).select("query_id", "item_id", "similarity", F.col("rank_no").cast("long").alias("rank_no")), SIM + "SELECT query_id, item_id, similarity, rank_no FROM hit WHERE similarity >= 0.3 AND rank_no <= 10"),
        "VE-02": (lambda t: _hits(t, 5).select("query_id", "item_id", "similarity"), SIM + "SELECT query_id, item_id, similarity FROM hit WHERE rank_no <= 5"),
        "VE-03": (_centroid_hits, CENTROID),
        "VE-04": (
            lambda t: vector.top_k(_queries(t), _vectors(t).where("label IN (1, 3, 5)"), 5, 0.1).select("query_id", "item_id", "similarity"),
            SIM + "SELECT query_id, item_id, similarity FROM sims WHERE label IN (1, 3, 5) AND similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) <= 5",
        ),
        "VE-05": (
            _reranked,
            SIM + """, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, label < 5 ORDER BY similarity DESC, item_id) AS rn FROM sims WHERE similarity >= 0), hot AS (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 3)
            SELECT query_id, item_id, round(similarity * CASE WHEN s.label IN (SELECT label FROM hot) THEN 1.3 ELSE 1 END::DOUBLE * CASE WHEN s.label <> e.label THEN 1.2 ELSE 1 END::DOUBLE * CASE WHEN abs(s.label - e.label) <= 1 THEN 1.1 ELSE 1 END::DOUBLE, 6) AS score FROM s JOIN e ON e.item_id = query_id WHERE rn <= 10""".replace("SELECT query_id, item_id, round", "SELECT query_id, s.item_id, round"),
        ),
        "VE-06": (
            lambda t: _hits(t, 10).join(_labels(t), "item_id").groupBy("query_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("evolution")),
            SIM + "SELECT query_id, label, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS evolution FROM hit WHERE rank_no <= 10 GROUP BY ALL",
        ),
        "VE-07": (
            lambda t: R.dominant(_hits(t, 10, 0.7).join(_labels(t), "item_id"), ["query_id"], "label").join(_labels(t).withColumnsRenamed({"item_id": "query_id", "label": "own"}), "query_id").where("dominant <> own").select("query_id", "own", F.col("dominant").alias("suggested")),
            SIM + ", v AS (SELECT query_id, label, count(*) AS n FROM hit WHERE rank_no <= 10 AND similarity >= 0.7 GROUP BY ALL), d AS (SELECT query_id, label FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1) SELECT query_id, e.label AS own, d.label AS suggested FROM d JOIN e ON e.item_id = query_id WHERE d.label <> e.label",
        ),
        "VE-08": (
            lambda t: R.dominant(_hits(t, 10).join(_labels(t), "item_id"), ["query_id"], "label").select("query_id", F.col("dominant").alias("recommended"), F.round(F.col("n") / 10, 4).alias("confidence")),
            SIM + ", v AS (SELECT query_id, label, count(*) AS n FROM hit WHERE rank_no <= 10 GROUP BY ALL) SELECT query_id, label AS recommended, round(n / 10, 4)::DOUBLE AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1",
        ),
        "VE-09": (
            lambda t: R.search(t.symbols, "rebuild", "name").select("id", "name").distinct(),
            "SELECT DISTINCT id, name FROM symbols WHERE name ILIKE '%rebuild%'",
        ),
        "STR-01": (
            lambda t: live.run_available(live.buffered(_stream(t), live.lateness(t.spark, t.where))).groupBy("entity").agg(F.max("edits").alias("edits"), F.max_by("buffered", "edits").alias("buffered")),
            "SELECT user_id AS entity, count(*) AS edits, least(count(*), 1000) AS buffered FROM events GROUP BY user_id",
        ),
        "STR-02": (
            lambda t: live.sessions(t.spark, t.where, "30 minutes"),
            """, g AS (SELECT user_id AS entity, ts, event_id, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true)::INT AS opens FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            n AS (SELECT *, sum(opens) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT entity, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS edits FROM n GROUP BY entity, k""",
        ),
        "STR-03": (
            lambda t: live.run_available(live.triggered(_stream(t), resets=False, late=live.lateness(t.spark, t.where))),
            """, ev AS (SELECT user_id AS entity, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_type = 'purchase' AS save, event_id % 9 AS dl, event_id % 2 AS ds FROM events WHERE ts IS NOT NULL),
            r AS (SELECT DISTINCT entity, 0::BIGINT AS event_id, 0::BIGINT AS rn, 0::BIGINT AS edits, 0::BIGINT AS lines, 0::BIGINT AS symbols, false AS fired FROM ev
              UNION ALL SELECT entity, event_id, rn, edits, lines, symbols, NOT save AND (lines >= 50 OR symbols >= 5 OR edits >= 50) FROM (SELECT ev.entity, ev.event_id, ev.rn, save,
              CASE WHEN save THEN CASE WHEN fired THEN 0 ELSE edits END WHEN fired THEN 1 ELSE edits + 1 END AS edits, CASE WHEN save THEN CASE WHEN fired THEN 0 ELSE lines END WHEN fired THEN dl ELSE lines + dl END AS lines, CASE WHEN save THEN CASE WHEN fired THEN 0 ELSE symbols END WHEN fired THEN ds ELSE symbols + ds END AS symbols FROM r JOIN ev ON ev.entity = r.entity AND ev.rn = r.rn + 1))
            SELECT entity, event_id, edits, lines, symbols FROM r WHERE fired""",
        ),
        "STR-04": (
            lambda t: live.run_available(live.triggered(_stream(t), late=live.lateness(t.spark, t.where))),
            """, ev AS (SELECT user_id AS entity, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_type = 'purchase' AS save, event_id % 9 AS dl, event_id % 2 AS ds FROM events WHERE ts IS NOT NULL),
            r AS (SELECT DISTINCT entity, 0::BIGINT AS event_id, 0::BIGINT AS rn, 0::BIGINT AS edits, 0::BIGINT AS lines, 0::BIGINT AS symbols, false AS fired FROM ev
              UNION ALL SELECT entity, event_id, rn, edits, lines, symbols, NOT save AND (lines >= 50 OR symbols >= 5 OR edits >= 50) FROM (SELECT ev.entity, ev.event_id, ev.rn, save,
              CASE WHEN save THEN 0 WHEN fired THEN 1 ELSE edits + 1 END AS edits, CASE WHEN save THEN 0 WHEN fired THEN dl ELSE lines + dl END AS lines, CASE WHEN save THEN 0 WHEN fired THEN ds ELSE symbols + ds END AS symbols FROM r JOIN ev ON ev.entity = r.entity AND ev.rn = r.rn + 1))
            SELECT entity, event_id, edits, lines, symbols FROM r WHERE fired""",
        ),
        "STR-05": (_watched, "SELECT user_id AS entity, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id"),
        "STR-06": (_queue, "SELECT user_id AS entity, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1"),
        "STR-07": (lambda t: live.fresh(t.symbol_versions.where("load_batch > 40").select("id", F.lower("body_hash").alias("h")).distinct(), t.symbol_versions.where("load_batch <= 40").select(F.lower("body_hash").alias("h")), ["h"]).select("id"), "SELECT DISTINCT id FROM symbol_versions WHERE load_batch > 40 AND (body_hash IS NULL OR lower(body_hash) NOT IN (SELECT lower(body_hash) FROM symbol_versions WHERE load_batch <= 40 AND body_hash IS NOT NULL))"),
        "STR-08": (
            lambda t: live.unexpired(t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts")), "ts", F.lit("2024-01-15 12:00:00").cast("timestamp"), 3600).select("event_id"),
            "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 11:00:00'",
        ),
        "STR-09": (
            lambda t: upserts.overlay(t.change.where("kind = 'F'").groupBy("path").agg(F.max("symbol_id").alias("v")), t.change.where("kind = 'O'").groupBy("path").agg(F.max("symbol_id").alias("v")), ["path"]),
            ", o AS (SELECT path, max(symbol_id) AS v FROM change WHERE kind = 'O' GROUP BY path) SELECT * FROM o UNION ALL SELECT path, max(symbol_id) FROM change WHERE kind = 'F' AND path NOT IN (SELECT path FROM o) GROUP BY path",
        ),
        "STR-10": (
            lambda t: t.change.groupBy("path", "kind").agg(F.max("lines").alias("score")).groupBy("path").agg(F.max(F.struct("score", "kind")).alias("b")).select("path", "b.kind", "b.score"),
            ", s AS (SELECT path, kind, max(lines) AS score FROM change GROUP BY ALL) SELECT path, kind, score FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, kind DESC) = 1",
        ),
        "VW-01": (
            _range_join,
            """, l AS (SELECT file_path, doc_id, sha, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE file_path IS NOT NULL AND sha IS NOT NULL AND text IS NOT NULL), r AS (SELECT file_path, min(doc_id) AS symbol FROM documents WHERE file_path IS NOT NULL GROUP BY file_path),
            p AS (SELECT symbol, sha, max(doc_id) AS doc_id FROM l JOIN r USING (file_path) WHERE line_no BETWEEN 2 AND 6 GROUP BY ALL) SELECT symbol, sha FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY doc_id DESC, sha) <= 10""",
        ),
        "VW-02": (
            lambda t: t.symbols.select("id", "load_batch").distinct().join(_versions(t), "load_batch", "left").where("pos IS NULL OR pos <= 20").select("id"),
            ", v AS (SELECT load_batch, row_number() OVER (ORDER BY load_batch) - 1 AS pos FROM (SELECT DISTINCT load_batch FROM symbol_versions)) SELECT id FROM (SELECT DISTINCT id, load_batch FROM symbols) LEFT JOIN v USING (load_batch) WHERE pos IS NULL OR pos <= 20",
        ),
        "VW-03": (
            lambda t: t.symbols.select("id", F.when(F.col("load_batch") % 10 > 0, F.col("load_batch")).alias("load_batch")).distinct().join(_versions(t), "load_batch", "left").where("load_batch IS NULL OR pos IS NOT NULL").groupBy(F.coalesce("pos", F.lit(-1)).alias("bucket")).agg(F.count(F.lit(1)).alias("edges")),
            ", v AS (SELECT load_batch, row_number() OVER (ORDER BY load_batch) - 1 AS pos FROM (SELECT DISTINCT load_batch FROM symbol_versions)), s AS (SELECT DISTINCT id, CASE WHEN load_batch % 10 > 0 THEN load_batch END AS load_batch FROM symbols) SELECT coalesce(pos, -1) AS bucket, count(*) AS edges FROM s LEFT JOIN v USING (load_batch) WHERE load_batch IS NULL OR pos IS NOT NULL GROUP BY 1",
        ),
        "VW-04": (
            lambda t: t.symbols.where("path IS NOT NULL").select("id", F.upper(F.substring_index(N.dirname(norm_path(F.col("path"))), "/", -1)).alias("d")).distinct().groupBy(F.when(F.col("d") == "", "ROOT").otherwise(F.col("d")).alias("directory")).agg(F.count(F.lit(1)).alias("refs")).orderBy(F.col("refs").desc(), "directory"),
            f", s AS (SELECT DISTINCT id, upper(regexp_extract(regexp_extract({_NPATH}, '^(.*)/[^/]*$', 1), '[^/]*$')) AS d FROM symbols WHERE path IS NOT NULL) SELECT CASE WHEN d = '' THEN 'ROOT' ELSE d END AS directory, count(*) AS refs FROM s GROUP BY 1",
        ),
        "VW-05": (
            lambda t: t.change.groupBy("path", "kind").agg(F.sum("lines").alias("s")).select("path", "kind", F.round(F.col("s") / F.greatest(F.max("s").over(W.partitionBy("path")), F.lit(1)), 6).alias("normal")),
            ", s AS (SELECT path, kind, sum(lines) AS s FROM change GROUP BY ALL) SELECT path, kind, round(s / greatest(max(s) OVER (PARTITION BY path), 1), 6) AS normal FROM s",
        ),
        "VW-06": (
            _symbol_lineage,
            """, s AS (SELECT DISTINCT lower(dna_id) AS dna, id, name, path, change_type, load_batch AS pos FROM symbols WHERE dna_id IS NOT NULL),
            l AS (SELECT a.id AS old_id, b.id AS new_id, CASE WHEN a.name IS DISTINCT FROM b.name THEN 'rename' WHEN a.path IS DISTINCT FROM b.path THEN 'relocate' ELSE 'refactor' END AS move_type FROM s a JOIN s b ON a.dna = b.dna AND b.pos = a.pos + 1 WHERE a.change_type = 'removed' AND b.change_type = 'added'),
            e AS (SELECT old_id AS symbol_id, * FROM l UNION ALL SELECT new_id, * FROM l), w AS (SELECT DISTINCT id AS symbol_id, load_batch AS pos FROM symbols) SELECT symbol_id, old_id, new_id, move_type, pos FROM e JOIN w USING (symbol_id)""",
        ),
        "VW-07": (
            _folders,
            f""", s AS (SELECT path, count(*) AS symbols FROM (SELECT DISTINCT {_NPATH} AS path, id FROM symbols WHERE path IS NOT NULL) GROUP BY path), h AS (SELECT {_NPATH.replace('path', 'file_path')} AS path, max(impact_score) AS score FROM symbol_history WHERE file_path IS NOT NULL AND isfinite(impact_score) GROUP BY 1)
            SELECT array_to_string(string_split(path, '/')[1:2], '/') AS folder, count(*) AS files, CAST(sum(symbols) AS BIGINT) AS symbols, count(*) FILTER (regexp_matches(path, '(?i){"|".join(S.RISK_WORDS.values())}')) AS risks, round(sum(coalesce(score, 0.0)), 4) AS score FROM s LEFT JOIN h USING (path) GROUP BY 1""",
        ),
        "VW-08": (
            _prefixes,
            f", p AS (SELECT DISTINCT string_split({_NPATH}, '/') AS p FROM files WHERE path IS NOT NULL), e AS (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM p) SELECT array_to_string(p[1:n], '/') AS id, p[n] AS name, CASE WHEN n > 1 THEN array_to_string(p[1:n-1], '/') END AS parent, bool_or(n = len(p)) AS is_file FROM e GROUP BY ALL",
        ),
        "VW-09": (
            lambda t: t.files.where("path IS NOT NULL").select(norm_path(F.col("path")).alias("path")).distinct().join(t.symbols.where("path IS NOT NULL").select(norm_path(F.col("path")).alias("path"), "name").distinct().groupBy("path").agg(F.count("name").alias("symbols"), F.min("name").alias("first_symbol")), "path", "left").na.fill(0, ["symbols"]),
            f", f AS (SELECT DISTINCT {_NPATH} AS path FROM files WHERE path IS NOT NULL), s AS (SELECT path, count(name) AS symbols, min(name) AS first_symbol FROM (SELECT DISTINCT {_NPATH} AS path, name FROM symbols WHERE path IS NOT NULL) GROUP BY path) SELECT path, coalesce(symbols, 0) AS symbols, first_symbol FROM f LEFT JOIN s USING (path)",
        ),
        "VW-10": (
            lambda t: t.documents.where(F.coalesce("file_path", "repo") == F.lit("src/parse/window.ts")).select("doc_id").unionByName(t.documents.where(F.col("file_path").isNull() & (F.col("repo") == "lazyworks/scope-payload")).select("doc_id")),
            "SELECT doc_id FROM documents WHERE coalesce(file_path, repo) IN ('src/parse/window.ts', 'lazyworks/scope-payload') AND (file_path IS NULL OR file_path = 'src/parse/window.ts')",
        ),
        "VW-11": (
            _counts,
            """, v AS (SELECT DISTINCT sha, CASE WHEN json_valid(risks) THEN risks END AS r, CASE WHEN json_valid(hotspots_json) THEN hotspots_json END AS h, CASE WHEN json_valid(raw_llm_json) THEN raw_llm_json END AS l FROM commits_analysis)
            SELECT sha, CASE WHEN json_type(r) = 'ARRAY' THEN json_array_length(r)::INT END AS risks, CASE WHEN json_type(h) = 'ARRAY' THEN json_array_length(h)::INT END AS hotspots, CASE WHEN json_type(l) = 'OBJECT' THEN len(json_keys(l))::INT END AS sections FROM v""",
        ),
        "VW-12": (
            lambda t: t.documents.where("text IS NOT NULL").select("doc_id", F.when(F.instr("text", "return") > 0, H.line_slice(F.col("text"), F.size(F.split(F.substring_index("text", "return", 1), "\n", -1)) - 5, F.size(F.split(F.substring_index("text", "return", 1), "\n", -1)) + 15)).otherwise(F.substring("text", 1, 1800)).alias("snippet")),
            ", x AS (SELECT doc_id, text, len(string_split(string_split(text, 'return')[1], chr(10))) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN contains(text, 'return') THEN array_to_string(string_split(text, chr(10))[greatest(n - 5, 1):n + 15], chr(10)) ELSE text[1:1800] END AS snippet FROM x",
        ),
        "VW-13": (
            lambda t: t.commits_analysis.select("sha", F.round(S.clamp(100 - 10 * F.col("symbols_removed") - 3 * F.col("edges_removed") - 0.5 * F.col("structural_change_score"), 0.0, 100.0), 6).alias("health")).distinct(),
            "SELECT DISTINCT sha, round(least(greatest(100 - 10 * symbols_removed - 3 * edges_removed - 0.5::DOUBLE * structural_change_score, 0.0), 100.0), 6) AS health FROM commits_analysis WHERE structural_change_score IS NOT NULL AND symbols_removed IS NOT NULL AND edges_removed IS NOT NULL",
        ),
        "VW-14": (
            _debt,
            drifting.STATES + drifting.LINKS + """, pl AS (SELECT DISTINCT name, path FROM have), j AS (SELECT CASE WHEN expect = 'present' AND h.key IS NULL AND p.path IS NULL THEN 'missing' WHEN expect = 'absent' AND h.key IS NOT NULL THEN 'zombie' END AS drift FROM want w LEFT JOIN have h ON h.key = w.key LEFT JOIN pl p ON p.name = w.name AND p.path = w.path),
            r AS (SELECT unnest([3, 5, 8])::BIGINT AS node UNION SELECT dst FROM r JOIN link ON src = node), x AS (SELECT (SELECT count(*) FROM j WHERE drift = 'missing') AS missing, (SELECT count(*) FROM j WHERE drift = 'zombie') AS zombies,
            (SELECT count(DISTINCT src) FROM link WHERE src IN (SELECT p_partkey FROM part WHERE p_type NOT LIKE 'PROMO%' AND p_size > 1 AND lower(p_name) NOT LIKE '%util%') AND src NOT IN (SELECT node FROM r)) AS dead,
            (SELECT count(DISTINCT dst) FROM edge WHERE dst IN (SELECT symbol_id FROM change WHERE change_type = 'removed')) AS leftovers) SELECT *, missing + zombies + dead + leftovers AS debt FROM x""",
        ),
        "VW-15": (
            lambda t: t.symbol_versions.select("id", _age(F.col("recorded_at").cast("timestamp")).alias("age")).distinct(),
            f", d AS (SELECT DISTINCT id, CAST(floor((epoch_us(TIMESTAMP '{domain.AS_OF}') - epoch_us(recorded_at)) / 86400000000.0) AS BIGINT) AS d FROM symbol_versions) SELECT id, CASE WHEN d IS NULL THEN 'Unknown' WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN d || ' days ago' WHEN d < 30 THEN d // 7 || ' weeks ago' WHEN d < 365 THEN d // 30 || ' months ago' ELSE d // 365 || ' years ago' END AS age FROM d",
        ),
        "VW-16": (
            lambda t: R.search(t.commits_analysis.where("summary_md IS NOT NULL"), "watcher", "summary_md").select("sha", (F.col("blast_radius") > 20).alias("is_pinned"), F.col("analyzed_at").cast("timestamp").alias("analyzed_at")).distinct().orderBy(F.col("is_pinned").desc(), F.col("analyzed_at").desc(), "sha"),
            "SELECT DISTINCT sha, blast_radius > 20 AS is_pinned, analyzed_at AT TIME ZONE 'UTC' AS analyzed_at FROM commits_analysis WHERE summary_md ILIKE '%watcher%'",
        ),
        "VW-17": (
            lambda t: R.first_n(t.symbols.where("confidence IS NOT NULL AND sha IS NOT NULL").select("sha", "id", "confidence").distinct().where("confidence >= 0.8"), 3, ["sha"], F.col("confidence").desc(), F.col("id")).select("sha", "id"),
            "SELECT sha, id FROM (SELECT DISTINCT sha, id, confidence FROM symbols WHERE confidence >= 0.8 AND NOT isnan(confidence) AND sha IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY sha ORDER BY confidence DESC, id) <= 3",
        ),
        "VW-18": (
            _top_actions,
            ACTIONS + "SELECT message, round(CASE priority WHEN 'urgent' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END * CASE effort WHEN 'xs' THEN 5 WHEN 's' THEN 4 WHEN 'm' THEN 3 WHEN 'l' THEN 2 ELSE 1 END * CASE risk WHEN 'low' THEN 1.5 WHEN 'medium' THEN 1.0 ELSE 0.7 END::DOUBLE, 4) AS score FROM ac ORDER BY 2 DESC, message LIMIT 5",
        ),
        "VW-19": (_actions, ACTIONS + "SELECT * FROM ac"),
        "VW-20": (lambda t: t.commits_analysis.where(F.size(F.from_json("risks", "array<string>")) > 0).select("sha", "risks").distinct(), "SELECT DISTINCT sha, risks FROM commits_analysis WHERE json_array_length(risks) > 0"),
        "VW-21": (
            lambda t: t.spark.createDataFrame([("staged",), ("unstaged",)], "sha string").unionByName(t.commit.where("sha > 1").select(F.col("sha").cast("string").alias("sha"))).unionByName(t.commit.where("sha = 1").select(F.lit("HEAD").alias("sha"))),
            "SELECT 'staged' AS sha UNION ALL SELECT 'unstaged' UNION ALL SELECT CAST(sha AS VARCHAR) FROM commit WHERE sha > 1 UNION ALL SELECT 'HEAD' FROM commit WHERE sha = 1",
        ),
        "VW-22": (
            lambda t: t.change.where("path = 3").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("change_type") == "removed").alias("drift")).withColumn("outgoing", t.edge.where("src = 3").agg(F.count(F.lit(1))).scalar()).withColumn("incoming", t.edge.where("dst = 3").agg(F.count(F.lit(1))).scalar()).withColumn("hotspot", matching._scored(t).where("path = 3").agg(F.round(F.max("score"), 4)).scalar()),
            matching._FILE_METRICS + "SELECT (SELECT count(*) FROM edge WHERE src = 3) AS outgoing, (SELECT count(*) FROM edge WHERE dst = 3) AS incoming, (SELECT round(max(score), 4) FROM h WHERE path = 3) AS hotspot, count(*) AS changes, count(*) FILTER (change_type = 'removed') AS drift FROM change WHERE path = 3",
        ),
        "SP-01": (_skeleton, f", f AS (SELECT DISTINCT {_NPATH} AS path FROM files WHERE path IS NOT NULL) SELECT path FROM f WHERE (path = 'src' OR starts_with(path, 'src/')) AND NOT regexp_matches(path, '^src/core/.*$') AND NOT regexp_matches(path, '^src/[^/]*/edge[^/]*/[^/]*$')"),
        "SP-02": (
            _languages,
            rf", f AS (SELECT DISTINCT path, lower(regexp_extract(regexp_extract(replace(path, chr(92), '/'), '[^/]*$'), '.\.([^.]*)$', 1)) AS ext FROM files WHERE path IS NOT NULL), l AS (SELECT * FROM (VALUES {', '.join(repr(x) for x in LANGUAGES.items())}) v(ext, language)) SELECT path, coalesce(language, 'unknown') AS language, language IN ('markdown', 'json', 'yaml', 'css') AS structural_only FROM f LEFT JOIN l USING (ext)",
        ),
        "SP-03": (lambda t: t.symbols.where(F.col("change_type").isin("added", "modified")).select(F.lower("dna_id").alias("dna")).distinct().join(t.symbols.where("change_type = 'removed'").select(F.lower("dna_id").alias("dna")), "dna", "left_anti"), "SELECT DISTINCT lower(dna_id) AS dna FROM symbols WHERE change_type IN ('added', 'modified') AND coalesce(lower(dna_id) NOT IN (SELECT lower(dna_id) FROM symbols WHERE change_type = 'removed' AND dna_id IS NOT NULL), true)"),
        "SP-04": (
            _status,
            ", r AS (SELECT lower(trim(sha)) AS sha, lower(status) AS status, analysis_version FROM commits_analysis QUALIFY row_number() OVER (PARTITION BY lower(trim(sha)) ORDER BY analyzed_at DESC NULLS LAST, lower(status) NULLS FIRST, analysis_version NULLS FIRST) = 1) SELECT sha, status FROM r WHERE NOT coalesce(status = 'complete' AND (list_transform(string_split(analysis_version, '.'), lambda x: coalesce(try_cast(x AS INT), 0)) || [0, 0, 0, 0])[1:4] >= [2, 0, 0, 0], false)",
        ),
        "SP-05": (lambda t: t.commits_analysis.groupBy("analysis_version").agg(F.count(F.lit(1)).alias("n")).select("analysis_version", "n", (H.version_key(F.col("analysis_version"))[0] == 2).alias("compatible")), "SELECT analysis_version, count(*) AS n, coalesce(try_cast(string_split(analysis_version, '.')[1] AS INT), CASE WHEN analysis_version IS NOT NULL THEN 0 END) = 2 AS compatible FROM commits_analysis GROUP BY analysis_version"),
        "SP-06": (lambda t: t.change.join(F.broadcast(t.commit.orderBy(F.col("date").desc(), F.col("sha").desc()).limit(25).select("sha")), "sha", "left_semi").select("symbol_id").distinct(), "SELECT DISTINCT symbol_id FROM change WHERE sha IN (SELECT sha FROM commit ORDER BY date DESC, sha DESC LIMIT 25)"),
        "SP-07": (lambda t: t.commit.where("status = 'P'").select("sha", "date").orderBy(F.col("date").desc(), "sha"), "SELECT sha, date FROM commit WHERE status = 'P'"),
        "SP-08": (
            lambda t: t.hybrid_facts.select("file_path", "version", "fact_id").distinct().join(t.hybrid_facts.where("id % 3 = 0").select("file_path", "version").distinct(), ["file_path", "version"]).select("file_path", "version", "fact_id"),
            "SELECT file_path, version, fact_id FROM (SELECT DISTINCT file_path, version, fact_id FROM hybrid_facts) JOIN (SELECT DISTINCT file_path, version FROM hybrid_facts WHERE id % 3 = 0) USING (file_path, version)",
        ),
        "SP-09": (
            lambda t: t.symbols.select("id", F.lower("dna_id").alias("dna"), "change_type").distinct().join(t.symbols.where("change_type = 'removed' AND dna_id IS NOT NULL").select(F.lower("dna_id").alias("dna")).distinct().withColumn("m", F.lit(True)), "dna", "left").select("id", F.when(F.col("m") & F.col("change_type").isin("added", "removed"), "moved").otherwise(F.col("change_type")).alias("change_type")),
            ", m AS (SELECT DISTINCT lower(dna_id) AS dna FROM symbols WHERE change_type = 'removed' AND dna_id IS NOT NULL) SELECT id, CASE WHEN m.dna IS NOT NULL AND change_type IN ('added', 'removed') THEN 'moved' ELSE change_type END AS change_type FROM (SELECT DISTINCT id, lower(dna_id) AS dna, change_type FROM symbols) s LEFT JOIN m USING (dna)",
        ),
        "SP-10": (
            lambda t: upserts.overlay(t.change.where("kind = 'F'").select(F.col("sha").alias("bundle"), F.col("path").alias("file")).distinct(), t.change.where("kind = 'O' AND sha % 2 = 0").select(F.col("sha").alias("bundle"), F.col("path").alias("file")).distinct(), ["bundle"]),
            ", n AS (SELECT DISTINCT sha AS bundle, path AS file FROM change WHERE kind = 'O' AND sha % 2 = 0) SELECT * FROM n UNION ALL SELECT DISTINCT sha, path FROM change WHERE kind = 'F' AND sha NOT IN (SELECT bundle FROM n)",
        ),
        "SP-11": (
            _cached_reports,
            ", f AS (SELECT DISTINCT id, sha256(concat_ws(':', file_path, version)) AS fingerprint FROM hybrid_facts) SELECT q.id AS query_id, f.id, fingerprint FROM f q JOIN f USING (fingerprint) WHERE q.id % 100 = 0",
        ),
        "SP-12": (_gaps, "SELECT * FROM (VALUES ('symbols', 'convention_confidence'), ('files', 'size')) v(table_name, missing)"),
    }
)
