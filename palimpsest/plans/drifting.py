"""Graphs and drift (GR, DR)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions.keys import strip
from ..operators import drift as D
from ..operators import graphs as G
from ..operators import hotspots
from ..operators import relational as R
from ..operators.upserts import latest
from ..sources import parsers
from . import domain
from .domain import Tables
from .matching import _FILE_METRICS
from .scalars import _CONV, STYLES
from .scans import _CODE

#: Names of the language's own methods (lower case), a parameter of the caller search.
BUILTINS = ["map", "filter", "reduce", "foreach", "push", "pop", "slice", "splice", "join", "split", "replace", "trim", "keys", "values", "entries", "log", "then", "catch", "call", "bind", "apply", "tostring", "len", "range", "print"]


def _links(t: Tables):
    """A graph whose nodes are both ends of line items."""
    return t.lineitem.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 17 + F.col("l_linenumber")).alias("dst"), F.round(1 - F.col("l_tax"), 4).alias("confidence")).distinct()


LINKS = ", link AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 17 + l_linenumber AS dst, round(1 - l_tax, 4) AS confidence FROM lineitem) "


def _entries(t: Tables):
    """Entry points among the symbols; a symbol's degrees are those of its id in the edges, its name is exported unless it begins with ``_``."""
    into = t.edge.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("fan_in"))
    out = t.edge.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("fan_out"))
    rows = _symbol_rows(t).join(into, "id", "left").join(out, "id", "left").na.fill(0, ["fan_in", "fan_out"])
    return rows.select("id", G.entry_point(F.col("name"), F.col("kind"), F.col("path"), F.col("fan_in"), F.col("fan_out"), ~F.col("name").startswith("_")).alias("is_entry"))


def _dead(t: Tables):
    """Nodes in scope (not promotional parts) with some complexity (size above 1) and no utility (container words), neither roots nor reached."""
    scope = t.part.where("p_type NOT LIKE 'PROMO%' AND p_size > 1 AND lower(p_name) NOT LIKE '%util%'").select(F.col("p_partkey").alias("node"))
    nodes = _links(t).select(F.col("src").alias("node")).distinct().join(scope, "node", "left_semi")
    return nodes.join(G.reach(_links(t), _roots(t)).select("node"), "node", "left_anti")


def _roots(t: Tables):
    return t.part.where("p_partkey IN (3, 5, 8)").select(F.col("p_partkey").alias("node"))


def _changes(t: Tables):
    return t.change.join(t.commit, "sha").select(F.col("symbol_id").cast("string").alias("key"), F.col("date").alias("at"), "sha", "change_type", "path")


def _renames(t: Tables):
    return t.change.where("path % 97 = 0").join(t.commit, "sha").select(F.col("symbol_id").cast("string").alias("old_key"), F.concat(F.col("symbol_id").cast("string"), F.lit("x")).alias("new_key"), F.col("date").alias("at"), "sha").distinct()


def _want(t: Tables):
    """Intended state by identity, from the latest symbol row."""
    rows = t.symbols.where("dna_id IS NOT NULL AND path IS NOT NULL").select(F.lower(F.btrim("dna_id")).alias("key"), "name", "path", "load_batch", "id", F.when(F.col("change_type") == "removed", D.ABSENT).otherwise(D.PRESENT).alias("expect")).distinct()
    return latest(rows, ["key"], F.col("load_batch").desc(), F.col("id").desc()).select("key", "expect", "name", "path")


def _have(t: Tables):
    rows = t.symbol_versions.where("load_batch <= 40").select(F.lower("dna_id").alias("key"), "name", "path", "load_batch", "id").distinct()
    return latest(rows, ["key"], F.col("load_batch").desc(), F.col("id").desc()).select("key", "name", "path")


STATES = """, want AS (SELECT key, expect, name, path FROM (SELECT DISTINCT lower(trim(dna_id)) AS key, name, path, load_batch, id, CASE WHEN change_type = 'removed' THEN 'absent' ELSE 'present' END AS expect FROM symbols WHERE dna_id IS NOT NULL AND path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY load_batch DESC, id DESC) = 1),
have AS (SELECT key, name, path FROM (SELECT DISTINCT lower(dna_id) AS key, name, path, load_batch, id FROM symbol_versions WHERE load_batch <= 40) QUALIFY row_number() OVER (PARTITION BY key ORDER BY load_batch DESC, id DESC) = 1) """


def _edge_states(t: Tables):
    want = t.edge.where("edge_type = 'O'")
    have = t.edge.where("confidence >= 0.93")
    keys = t.change.where("change_type = 'added' AND lines > 45").select(F.col("path").alias("key")).distinct()
    return want, have, keys


EDGE_STATES = ", we AS (SELECT DISTINCT src, dst, edge_type FROM edge WHERE edge_type = 'O'), he AS (SELECT DISTINCT src, dst, edge_type FROM edge WHERE confidence >= 0.93), ks AS (SELECT DISTINCT path AS key FROM change WHERE change_type = 'added' AND lines > 45) "


def _calls(t: Tables):
    code = t.documents.where(_CODE)
    words = F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), F.lit(1))
    return code.select(F.col("doc_id").alias("caller"), F.explode(words).alias("callee")).where(~F.col("callee").isin(parsers.NO_CALLS))


def _fallback(t: Tables):
    hot = hotspots.scored(hotspots.file_metrics(t.change.join(t.commit, "sha"), "path", "sha", "author", "date", F.lit(domain.AS_OF).cast("timestamp"), t.commit.count()))
    top = hot.where("score >= 40").orderBy(F.col("score").desc(), "path").limit(100).select(F.col("path").alias("key"))
    moved = t.change.where("path % 97 = 0").select((F.col("path") + 100000).alias("key")).distinct()
    empty = t.change.where("kind = 'none'").select(F.col("path").alias("key"))
    return D.or_else(empty, top.unionByName(moved).distinct())


def _facts(t: Tables, side: str):
    half = t.hybrid_facts.where("fact_id IS NOT NULL").select(F.concat_ws("/", "file_path", "fact_id").alias("id"), F.col("fact_id").alias("name"), F.coalesce("file_path", F.lit("")).alias("kind"), "hash", F.col("id").alias("n")).distinct()
    rows = half.where("n % 2 = 0") if side == "old" else half.where("n % 2 = 1")
    return latest(rows, ["id"], F.col("n").desc()).select("id", "name", "kind", "hash")


FACTS = """, fa AS (SELECT DISTINCT concat_ws('/', file_path, fact_id) AS id, fact_id AS name, coalesce(file_path, '') AS kind, hash, id AS n FROM hybrid_facts WHERE fact_id IS NOT NULL), fo AS (SELECT id, name, kind, hash FROM fa WHERE n % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1), fn AS (SELECT id, name, kind, hash FROM fa WHERE n % 2 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1) """


def _hybrid(t: Tables):
    """Structural facts: wanted (old half) against there (new half) by (path, fact); one whose wanted state is among the fact's last three rows was modified, another is divergent."""
    a = _facts(t, "old").select("kind", "name", F.struct("hash").alias("a"))
    b = _facts(t, "new").select("kind", "name", F.struct("hash").alias("b"))
    rows = t.hybrid_facts.where("fact_id IS NOT NULL").select(F.coalesce("file_path", F.lit("")).alias("kind"), F.col("fact_id").alias("name"), "hash", "id").distinct()
    recent = R.first_n(rows, 3, ["kind", "name"], F.col("id").desc()).where("hash IS NOT NULL").select("kind", "name", F.col("hash").alias("_h")).distinct().withColumn("recent", F.lit(True))
    met = a.join(b, ["kind", "name"], "full_outer").withColumn("_h", F.col("a.hash")).join(recent, ["kind", "name", "_h"], "left")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "zombie").when(F.col("a.hash").eqNullSafe(F.col("b.hash")), "same").when(F.col("recent"), "modified").otherwise("divergent")
    return met.groupBy(F.col("kind").alias("file_path"), state.alias("state")).agg(F.count(F.lit(1)).alias("facts"))


def _snapshot(t: Tables, low: int, high: int):
    rows = t.symbol_versions.where(f"load_batch BETWEEN {low} AND {high}").select(F.lower("dna_id").alias("key"), "name", F.lower("signature_hash").alias("signature_hash"), F.lower("body_hash").alias("body_hash"), "id").distinct()
    return latest(rows, ["key"], F.col("id").desc())


SNAPSHOTS = """, sa AS (SELECT * FROM (SELECT DISTINCT lower(dna_id) AS key, name, lower(signature_hash) AS signature_hash, lower(body_hash) AS body_hash, id FROM symbol_versions WHERE load_batch BETWEEN 1 AND 30) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id DESC) = 1),
sb AS (SELECT * FROM (SELECT DISTINCT lower(dna_id) AS key, name, lower(signature_hash) AS signature_hash, lower(body_hash) AS body_hash, id FROM symbol_versions WHERE load_batch BETWEEN 31 AND 99) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id DESC) = 1) """


def _history(t: Tables):
    """Every change of every symbol with the context of its commit, in rows: no history is cut or gathered in one array."""
    rows = t.symbol_history.where("symbol_dna_id IS NOT NULL").select(F.lower(strip(F.col("symbol_dna_id"))).alias("dna"), "id", "change_type", F.lower(strip(F.col("sha"))).alias("sha")).distinct()
    commits = t.commits_metadata.where("sha IS NOT NULL").groupBy(F.lower(strip(F.col("sha"))).alias("sha")).agg(F.max_by(F.struct("author", "message"), F.struct("load_batch", F.struct("author", "message"))).alias("c"))
    return rows.join(commits, "sha", "left").select("dna", "id", F.coalesce("change_type", F.lit("?")).alias("change_type"), "c.author", "c.message")


def _bundle(t: Tables):
    """One nested record of bundle facts, from single-row aggregates."""
    scope = t.commit.agg(F.struct(F.count(F.lit(1)).alias("commits"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last"))).scalar()
    symbols = t.change.agg(F.struct(F.count_if(F.col("change_type") == "added").alias("added"), F.count_if(F.col("change_type") == "removed").alias("removed"))).scalar()
    top = t.change.groupBy("path").agg(F.count(F.lit(1)).alias("changes")).orderBy(F.col("changes").desc(), "path").limit(3)
    hot = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("changes")).alias("k"), "path"))), lambda x: F.struct(x["path"].alias("path"), (-x["k"]).alias("changes")))).scalar()  # three files
    graph = t.edge.agg(F.struct(F.count(F.lit(1)).alias("edges"), F.countDistinct("edge_type").alias("types")))
    record = F.struct(scope.alias("scope"), symbols.alias("symbols"), hot.alias("hotspots"), F.col("graph"))
    return graph.toDF("graph").select(F.to_json(record).alias("facts"))


def _conventions(t: Tables):
    """Adoption of a convention: its timeline, the history of each file, and the files that lag behind (below half at their last load)."""
    rows = t.symbols.where("naming_convention IS NOT NULL").select("id", "path", "load_batch", (F.col("naming_convention") == "camelCase").alias("yes")).distinct()
    counts = [F.count_if("yes").alias("adopted"), F.count(F.lit(1)).alias("symbols")]
    line = R.running_share(rows.groupBy("load_batch").agg(*counts), ["load_batch"], "adopted", "symbols", "adoption").select(F.lit("timeline").alias("part"), F.lit(None).cast("string").alias("path"), "load_batch", "adopted", "symbols", "adoption")
    w = W.partitionBy("path").orderBy("load_batch").rowsBetween(W.unboundedPreceding, 0)  # a row per load
    files = rows.where("path IS NOT NULL").groupBy("path", "load_batch").agg(*counts).withColumn("adoption", F.round(100 * F.sum("adopted").over(w) / F.sum("symbols").over(w), 4))
    files = files.select(F.lit("history").alias("part"), "path", "load_batch", "adopted", "symbols", "adoption")
    late = R.first_n(files, 1, ["path"], F.col("load_batch").desc()).where("adoption < 50").withColumn("part", F.lit("lagger"))
    return line.unionByName(files).unionByName(late)


def _symbol_rows(t: Tables):
    return t.symbols.where("name IS NOT NULL AND path IS NOT NULL").select("id", "name", "path", "kind").distinct()


_RELEVANT = f""", sr AS (SELECT DISTINCT id, name, path, kind FROM symbols WHERE name IS NOT NULL AND path IS NOT NULL), sc AS (SELECT path, {_CONV} AS c FROM sr), cc AS (SELECT path, c, count(*) AS n FROM sc WHERE c <> 'unknown' GROUP BY ALL),
dm AS (SELECT path, c AS dominant, n FROM cc QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, list_position({N.CONVENTIONS}, c)) = 1), tt AS (SELECT path, CAST(sum(n) AS BIGINT) AS relevant, count(*) AS styles FROM cc GROUP BY path) """

QUERIES = domain.catalogue(
    {
        "GR-01": (
            lambda t: G.neighbours(t.edge, 5, "O", "F", 50),
            """, x AS (SELECT 'calls' AS direction, dst AS neighbour FROM edge WHERE src = 5 AND edge_type = 'O' UNION SELECT 'called_by', src FROM edge WHERE dst = 5 AND edge_type = 'O' UNION SELECT 'imports', dst FROM edge WHERE src = 5 AND edge_type = 'F')
            SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY direction ORDER BY neighbour) <= 50""",
        ),
        "GR-02": (
            lambda t: G.blast_radius(t.edge, t.change.where("change_type = 'removed' AND lines > 48").select(F.col("path").alias("id")).distinct()),
            ", c AS (SELECT DISTINCT path AS id FROM change WHERE change_type = 'removed' AND lines > 48) SELECT id, (SELECT count(DISTINCT src) FROM edge WHERE dst = id) AS callers, (SELECT count(DISTINCT dst) FROM edge WHERE src = id) AS callees FROM c",
        ),
        "GR-03": (
            lambda t: G.weighted_neighbourhood(_links(t), _roots(t), "confidence").select("node", F.round("weight", 6).alias("weight")).orderBy(F.col("weight").desc(), "node").limit(20),
            LINKS
            + """, both_ways AS (SELECT src, dst, confidence FROM link UNION ALL SELECT dst, src, confidence FROM link), bfs AS (SELECT unnest([3, 5, 8]) AS node, 0 AS depth UNION SELECT b.dst, depth + 1 FROM bfs JOIN both_ways b ON b.src = node WHERE depth < 3), d AS (SELECT node, min(depth) AS depth FROM bfs GROUP BY node)
            SELECT b.dst AS node, round(sum(confidence / (y.depth + 1)), 6) AS weight FROM both_ways b JOIN d x ON x.node = b.src JOIN d y ON y.node = b.dst WHERE y.depth = x.depth + 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
        ),
        "GR-04": (lambda t: G.reach(_links(t), _roots(t)).select("node"), LINKS + ", r AS (SELECT unnest([3, 5, 8])::BIGINT AS node UNION SELECT dst FROM r JOIN link ON src = node) SELECT node FROM r"),
        "GR-05": (
            _entries,
            rf""", sr AS (SELECT DISTINCT id, name, path, kind FROM symbols WHERE name IS NOT NULL AND path IS NOT NULL), fi AS (SELECT dst AS id, count(DISTINCT src) AS fan_in FROM edge GROUP BY dst), fo AS (SELECT src AS id, count(DISTINCT dst) AS fan_out FROM edge GROUP BY src)
            SELECT id, coalesce(CASE WHEN regexp_matches(name, '^(get|set|is|has|can)[A-Z]') AND NOT regexp_matches(lower(path), 'controller|service') THEN false
            WHEN kind IN ('function', 'method') AND (lower(name) IN ('main', 'run', 'start', 'init', 'setup', 'bootstrap', 'create', 'build') OR regexp_matches(name, '^on[A-Z]') OR regexp_matches(lower(name), 'handle|process|execute|render|mount|unmount|destroy')) THEN true
            WHEN kind = 'class' AND regexp_matches(lower(name), 'controller|service|provider|component|view|page') THEN true WHEN regexp_matches(lower(path), 'controller|route|middleware|bootstrap|app\.|main\.|index\.') THEN true ELSE NOT starts_with(name, '_') AND coalesce(fan_in, 0) = 0 AND coalesce(fan_out, 0) > 0 END, false) AS is_entry FROM sr LEFT JOIN fi USING (id) LEFT JOIN fo USING (id)""",
        ),
        "GR-06": (
            _dead,
            LINKS + ", r AS (SELECT unnest([3, 5, 8])::BIGINT AS node UNION SELECT dst FROM r JOIN link ON src = node) SELECT DISTINCT src AS node FROM link WHERE src IN (SELECT p_partkey FROM part WHERE p_type NOT LIKE 'PROMO%' AND p_size > 1 AND lower(p_name) NOT LIKE '%util%') AND src NOT IN (SELECT node FROM r)",
        ),
        "GR-07": (
            lambda t: t.edge.join(t.change.where("change_type = 'removed'").select(F.col("symbol_id").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("dst").alias("symbol_id")).agg(F.countDistinct("src").alias("callers")),
            "SELECT dst AS symbol_id, count(DISTINCT src) AS callers FROM edge WHERE dst IN (SELECT symbol_id FROM change WHERE change_type = 'removed') GROUP BY 1",
        ),
        "GR-08": (
            lambda t: G.resolve_ends(
                t.symbols.where("name IS NOT NULL").select("id", F.when(F.col("id") % 2 == 0, F.lower("dna_id")).otherwise(F.col("name")).alias("dst"), F.col("kind").alias("end_kind")).where("dst IS NOT NULL").distinct(),
                t.symbol_versions.where("name IS NOT NULL").select(F.lower("dna_id").alias("id"), "name", "kind").distinct(), "dst",
            ).select("id", "dst"),
            """, sv AS (SELECT DISTINCT lower(dna_id) AS id, name, kind FROM symbol_versions WHERE name IS NOT NULL), e AS (SELECT * FROM (SELECT DISTINCT id, CASE WHEN id % 2 = 0 THEN lower(dna_id) ELSE name END AS dst, kind AS end_kind FROM symbols WHERE name IS NOT NULL) WHERE dst IS NOT NULL),
            i AS (SELECT DISTINCT id AS k FROM sv), n AS (SELECT name AS k, min(id) AS v FROM sv GROUP BY name HAVING count(DISTINCT id) = 1), q AS (SELECT name AS k, kind, min(id) AS v FROM sv GROUP BY ALL HAVING count(DISTINCT id) = 1)
            SELECT e.id, coalesce(i.k, n.v, q.v, 'unknown:' || dst) AS dst FROM e LEFT JOIN i ON i.k = dst LEFT JOIN n ON n.k = dst LEFT JOIN q ON q.k = dst AND q.kind = end_kind""",
        ),
        "GR-09": (
            lambda t: G.reverse_index(t.edge, 1000).select("node", "part", F.array_join(F.transform("incoming", lambda x: x.cast("string")), ",").alias("incoming")),
            ", p AS (SELECT dst AS node, src, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 1000 AS part FROM (SELECT DISTINCT src, dst FROM edge)) SELECT node, part, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS incoming FROM p GROUP BY ALL",
        ),
        "GR-10": (lambda t: G.dag_levels(_links(t).where("src < dst"), _links(t).select(F.explode(F.array("src", "dst")).alias("node"))), None),
        "DR-01": (
            lambda t: D.intended(_changes(t), _renames(t)),
            """, ch AS (SELECT CAST(symbol_id AS VARCHAR) AS key, date AS ts, sha, change_type FROM change JOIN commit USING (sha)), rn AS (SELECT DISTINCT CAST(symbol_id AS VARCHAR) AS old_key, symbol_id || 'x' AS new_key, date AS ts, sha FROM change JOIN commit USING (sha) WHERE path % 97 = 0),
            ev AS (SELECT key, ts, sha, 1 AS phase, 'present' AS expect FROM ch WHERE change_type IN ('added', 'modified') UNION ALL SELECT new_key, ts, sha, 2, 'present' FROM rn UNION ALL SELECT old_key, ts, sha, 3, 'absent' FROM rn UNION ALL SELECT key, ts, sha, 4, 'absent' FROM ch WHERE change_type = 'removed' AND (key, sha) NOT IN (SELECT (old_key, sha) FROM rn))
            SELECT key, expect, sha FROM ev QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, sha DESC, phase DESC) = 1""",
        ),
        "DR-02": (_fallback, _FILE_METRICS + "SELECT path AS key FROM (SELECT * FROM h WHERE score >= 40 ORDER BY score DESC, path LIMIT 100) UNION SELECT path + 100000 FROM change WHERE path % 97 = 0"),
        "DR-03": (
            lambda t: D.symbol_drift(_want(t), _have(t)),
            STATES + """, pl AS (SELECT DISTINCT name, path FROM have), j AS (SELECT w.key, CASE WHEN expect = 'present' AND h.key IS NULL AND p.path IS NULL THEN 'missing' WHEN expect = 'absent' AND h.key IS NOT NULL THEN 'zombie' WHEN expect = 'present' AND h.key IS NOT NULL AND (h.name IS DISTINCT FROM w.name OR h.path IS DISTINCT FROM w.path) THEN 'divergent' END AS drift FROM want w LEFT JOIN have h ON h.key = w.key LEFT JOIN pl p ON p.name = w.name AND p.path = w.path) SELECT * FROM j WHERE drift IS NOT NULL""",
        ),
        "DR-04": (lambda t: D.missing_edges(*_edge_states(t)), EDGE_STATES + "SELECT * FROM we WHERE (src, dst, edge_type) NOT IN (SELECT (src, dst, edge_type) FROM he) AND (src IN (SELECT key FROM ks) OR dst IN (SELECT key FROM ks))"),
        "DR-05": (
            lambda t: D.zombie_edges(_edge_states(t)[0], _edge_states(t)[1], _edge_states(t)[2].withColumn("expect", F.when(F.col("key") % 2 == 0, D.ABSENT).otherwise(D.PRESENT))),
            EDGE_STATES + "SELECT * FROM he WHERE (src IN (SELECT key FROM ks) OR dst IN (SELECT key FROM ks)) AND ((src, dst, edge_type) NOT IN (SELECT (src, dst, edge_type) FROM we) OR src IN (SELECT key FROM ks WHERE key % 2 = 0) OR dst IN (SELECT key FROM ks WHERE key % 2 = 0))",
        ),
        "DR-06": (
            lambda t: D.unresolved_callers(_calls(t), t.symbols.where("name IS NOT NULL").select("name"), BUILTINS).select("caller", "callee", "n", F.round("severity", 6).alias("severity")),
            rf""", ca AS (SELECT doc_id AS caller, unnest(regexp_extract_all(text, '(\w+)\s*\(', 1)) AS callee FROM documents WHERE {_CODE}), un AS (SELECT caller, callee, count(*) AS n FROM ca WHERE callee NOT IN ({', '.join(map(repr, parsers.NO_CALLS))}) AND lower(callee) NOT IN ({', '.join(map(repr, BUILTINS))}) AND callee NOT IN (SELECT name FROM symbols WHERE name IS NOT NULL) GROUP BY ALL)
            SELECT caller, callee, n, round(least(1.0, least(1.0, ln(1 + n) / ln(6)) + 0.1)::DOUBLE, 6) AS severity FROM un""",
        ),
        "DR-07": (lambda t: D.convention_drift(_symbol_rows(t), ["path"]), _RELEVANT + "SELECT path, dominant, relevant, round(100 * (relevant - n) / relevant, 4) AS drift_percent FROM tt JOIN dm USING (path)"),
        "DR-08": (
            lambda t: _symbol_rows(t).withColumn("c", N.convention(F.col("name"))).where("c <> 'unknown'").groupBy("path").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("c").alias("styles")).where("symbols >= 2 AND styles > 1"),
            _RELEVANT + "SELECT path, relevant AS symbols, styles FROM tt WHERE relevant >= 2 AND styles > 1",
        ),
        "DR-09": (
            lambda t: D.style_drift(t.symbols.where("path IS NOT NULL").select("path").distinct().select(F.substring_index("path", "/", 1).alias("top"), N.file_style(F.col("path")).alias("style")), ["top"], "style", N.CONVENTIONS),
            STYLES + f""", st AS (SELECT string_split(path, '/')[1] AS top, style FROM styled), sn AS (SELECT top, style, count(*) AS n FROM st GROUP BY ALL), sd AS (SELECT top, style AS dominant, n FROM sn QUALIFY row_number() OVER (PARTITION BY top ORDER BY n DESC, list_position({N.CONVENTIONS}, style)) = 1)
            SELECT top, dominant, round(100 * (total - n) / total, 4) AS drift_percent FROM sd JOIN (SELECT top, count(*) AS total FROM st GROUP BY top) USING (top)""",
        ),
        "DR-10": (
            _conventions,
            """, c AS (SELECT DISTINCT id, path, load_batch, naming_convention = 'camelCase' AS yes FROM symbols WHERE naming_convention IS NOT NULL),
            tl AS (SELECT load_batch, count(*) FILTER (yes) AS adopted, count(*) AS symbols FROM c GROUP BY load_batch), fl AS (SELECT path, load_batch, count(*) FILTER (yes) AS adopted, count(*) AS symbols FROM c WHERE path IS NOT NULL GROUP BY ALL),
            h AS (SELECT path, load_batch, adopted, symbols, round(100 * sum(adopted) OVER w / sum(symbols) OVER w, 4) AS adoption FROM fl WINDOW w AS (PARTITION BY path ORDER BY load_batch))
            SELECT 'timeline' AS part, NULL AS path, load_batch, adopted, symbols, round(100 * sum(adopted) OVER w / sum(symbols) OVER w, 4) AS adoption FROM tl WINDOW w AS (ORDER BY load_batch)
            UNION ALL SELECT 'history', * FROM h UNION ALL SELECT 'lagger', * FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY load_batch DESC) = 1) WHERE adoption < 50""",
        ),
        "DR-11": (
            _hybrid,
            FACTS + """, l3 AS (SELECT kind, name, hash FROM (SELECT DISTINCT kind, name, hash, n FROM fa) QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY n DESC) <= 3), rc AS (SELECT DISTINCT kind, name, hash FROM l3 WHERE hash IS NOT NULL)
            SELECT coalesce(a.kind, b.kind) AS file_path, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'zombie' WHEN a.hash IS NOT DISTINCT FROM b.hash THEN 'same' WHEN rc.hash IS NOT NULL THEN 'modified' ELSE 'divergent' END AS state, count(*) AS facts FROM fo a FULL JOIN fn b ON a.kind = b.kind AND a.name = b.name LEFT JOIN rc ON rc.kind = a.kind AND rc.name = a.name AND rc.hash = a.hash GROUP BY ALL""",
        ),
        "DR-12": (
            lambda t: D.fact_delta(_facts(t, "old"), _facts(t, "new")),
            FACTS + ", bn AS (SELECT name, kind, arg_min_null(hash, id) AS hash, min(id) AS mid FROM fo GROUP BY ALL) SELECT n.id, CASE WHEN o.id IS NULL AND bn.name IS NULL THEN 'added' WHEN coalesce(o.hash, bn.hash) IS NOT DISTINCT FROM n.hash THEN 'unchanged' ELSE 'modified' END AS state FROM fn n LEFT JOIN fo o ON o.id = n.id LEFT JOIN bn ON bn.name = n.name AND bn.kind = n.kind",
        ),
        "DR-13": (
            lambda t: R.diff(_facts(t, "old").select("id", "hash"), _facts(t, "new").select("id", "hash"), ["id"], "hash"),
            FACTS + "SELECT id, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.hash IS NOT DISTINCT FROM b.hash THEN 'unchanged' ELSE 'modified' END AS state FROM fo a FULL JOIN fn b USING (id)",
        ),
        "DR-14": (
            lambda t: D.first_and_last(t.symbols.where("change_type = 'removed' AND dna_id IS NOT NULL").select(F.lower("dna_id").alias("dna"), "load_batch"), "dna", "load_batch"),
            ", x AS (SELECT lower(dna_id) AS dna, load_batch FROM symbols WHERE change_type = 'removed' AND dna_id IS NOT NULL) SELECT dna, min(load_batch) AS introduced, CASE WHEN max(load_batch) < (SELECT max(load_batch) FROM x) THEN max(load_batch) + 1 END AS resolved FROM x GROUP BY dna",
        ),
        "DR-15": (
            lambda t: D.symbol_diff(_snapshot(t, 1, 30), _snapshot(t, 31, 99)),
            SNAPSHOTS + """, s AS (SELECT key, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.name IS DISTINCT FROM b.name THEN 'renamed' WHEN a.signature_hash IS DISTINCT FROM b.signature_hash AND a.body_hash IS DISTINCT FROM b.body_hash THEN 'modified_both' WHEN a.signature_hash IS DISTINCT FROM b.signature_hash THEN 'modified_signature' WHEN a.body_hash IS DISTINCT FROM b.body_hash THEN 'modified_body' END AS state FROM sa a FULL JOIN sb b USING (key)) SELECT * FROM s WHERE state IS NOT NULL""",
        ),
        "DR-16": (
            lambda t: D.symbol_diff(_snapshot(t, 1, 30), _snapshot(t, 31, 99).where(~F.col("name").startswith("_"))).where("state IN ('modified_both', 'modified_signature')"),
            SNAPSHOTS + "SELECT key, CASE WHEN a.body_hash IS DISTINCT FROM b.body_hash THEN 'modified_both' ELSE 'modified_signature' END AS state FROM sa a JOIN sb b USING (key) WHERE NOT starts_with(b.name, '_') AND a.name IS NOT DISTINCT FROM b.name AND a.signature_hash IS DISTINCT FROM b.signature_hash",
        ),
        "DR-17": (
            _history,
            """, h AS (SELECT DISTINCT lower(trim(symbol_dna_id, ' \t\n\r')) AS dna, id, coalesce(change_type, '?') AS change_type, lower(trim(sha, ' \t\n\r')) AS sha FROM symbol_history WHERE symbol_dna_id IS NOT NULL),
            c AS (SELECT lower(trim(sha, ' \t\n\r')) AS sha, author, message FROM commits_metadata WHERE sha IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(sha, ' \t\n\r')) ORDER BY load_batch DESC, author DESC NULLS LAST, message DESC NULLS LAST) = 1)
            SELECT dna, id, change_type, author, message FROM h LEFT JOIN c USING (sha)""",
        ),
        "DR-18": (
            _bundle,
            """, hot AS (SELECT path, count(*) AS n FROM change GROUP BY path ORDER BY n DESC, path LIMIT 3)
            SELECT '{"scope":{"commits":' || (SELECT count(*) FROM commit) || ',"last":"' || (SELECT strftime(max(date), '%Y-%m-%d') FROM commit) || '"},"symbols":{"added":' || (SELECT count(*) FROM change WHERE change_type = 'added') || ',"removed":' || (SELECT count(*) FROM change WHERE change_type = 'removed')
            || '},"hotspots":[' || (SELECT string_agg('{"path":' || path || ',"changes":' || n || '}', ',' ORDER BY n DESC, path) FROM hot) || '],"graph":{"edges":' || (SELECT count(*) FROM edge) || ',"types":' || (SELECT count(DISTINCT edge_type) FROM edge) || '}}' AS facts""",
        ),
        "DR-19": (lambda t: t.file.join(t.commit, "sha").groupBy("path").agg(F.max_by("sha", F.struct("date", "sha")).alias("sha")), "SELECT path, arg_max(sha, (date, sha)) AS sha FROM file JOIN commit USING (sha) GROUP BY path"),
    }
)
