"""Filters, joins, aggregates, windows, sorts and set operations (FLT, JN, AG, WN, SO, ST)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import norm_source
from ..operators import relational as R
from . import domain
from .domain import Tables

_DAY = 86_400_000_000.0


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def _best_match(t: Tables):
    """Removed names with their best added name of the same commit and kind (normalised edit similarity of at least 0.8)."""
    sha = F.lower(F.btrim("sha")).alias("sha")
    removed = t.symbols.where("change_type = 'removed' AND name IS NOT NULL").select(sha, "kind", F.col("id").alias("old_id"), F.col("name").alias("old_name")).distinct()
    added = t.symbols.where("change_type = 'added' AND name IS NOT NULL").select(sha, "kind", F.col("id").alias("new_id"), F.col("name").alias("new_name")).distinct()
    pairs = R.similar_names(removed, added, ["sha", "kind"], "old_id", "old_name", "new_id", "new_name", 0.8)
    return R.first_n(pairs, 1, ["old_id"], F.col("score").desc(), F.col("new_id")).select("old_id", "new_id", "score")


def _same_body(t: Tables):
    """Blocks with a later block of the same body hash: the first of the same name, else the first of all; copies do not multiply."""
    rows = t.symbol_versions.where("body_hash IS NOT NULL").select(F.lower("body_hash").alias("h"), "id", "name", "load_batch").distinct()
    old, new = rows.where("load_batch <= 20").select("h", F.col("id").alias("a"), "name"), rows.where("load_batch > 20")
    named = new.groupBy("h", "name").agg(F.min("id").alias("same"))
    any_ = new.groupBy("h").agg(F.min("id").alias("other"))
    return old.join(any_, "h").join(named, ["h", "name"], "left").select("a", F.coalesce("same", "other").alias("b"), F.when(F.col("same").isNotNull(), 1.0).otherwise(0.9).alias("score"))


def _moved_names(t: Tables):
    """Removed symbols with the first added symbol of the same name and kind on another path; two candidates per name suffice."""
    old = t.symbols.where("change_type = 'removed'").select("name", "kind", F.col("path").alias("old_path"), F.col("id").alias("a")).distinct()
    new = t.symbols.where("change_type = 'added' AND path IS NOT NULL").groupBy("name", "kind", "path").agg(F.min("id").alias("b"))
    two = R.first_n(new, 2, ["name", "kind"], F.col("b"), F.col("path"))
    return old.join(two, ["name", "kind"]).where("old_path <> path").groupBy("a").agg(F.min("b").alias("b"))


def _enriched(t: Tables):
    top = t.change.groupBy("path").agg(F.count(F.lit(1)).alias("changes")).orderBy(F.col("changes").desc(), "path").limit(100)
    churn = t.change.groupBy("path").agg(F.sum("lines").cast("long").alias("churn"))
    return top.join(churn.join(F.broadcast(top.select("path")), "path", "left_semi"), "path", "left")  # 100 rows at any size


def _zero_filled(t: Tables):
    skeleton = t.part.where("p_size <= 10").select(F.col("p_partkey").alias("path"))
    counts = t.change.where("change_type = 'removed'").join(skeleton, "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return skeleton.join(counts, "path", "left").na.fill(0, ["n"])


def _two_stage(t: Tables):
    working = t.symbols.select(F.lower("dna_id").alias("dna"), "name", "path", "id")
    by_key = working.where("dna IS NOT NULL").groupBy("dna").agg(F.min("id").alias("by_key"))
    by_name = working.where("name IS NOT NULL AND path IS NOT NULL").groupBy("name", "path").agg(F.min("id").alias("by_name"))
    wanted = t.symbol_versions.select("id", F.lower("dna_id").alias("dna"), "name", "path").distinct()
    return wanted.join(by_key, "dna", "left").join(by_name, ["name", "path"], "left").select("id", F.coalesce("by_key", "by_name").alias("found_id"))


def _commit_fold(t: Tables):
    per = t.change.groupBy("sha").agg(F.sum("lines").cast("long").alias("lines"), F.max("discount").alias("structural"), F.array_sort(F.collect_set("kind")).alias("risks"))
    hits = R.first_n(t.change.select("sha", "symbol_id", "lines", "path"), 10, ["sha"], F.col("lines").desc(), F.col("symbol_id"), F.col("path"))
    impact = hits.groupBy("sha").agg(F.sum("lines").cast("long").alias("top_impact"))
    return per.join(impact, "sha").select("sha", "lines", "structural", F.array_join("risks", "|").alias("risks"), "top_impact")


def _adoption(t: Tables):
    per = t.commit.join(t.change, "sha", "left").groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count_if(F.col("kind") == "O").alias("adopted"), F.count("kind").alias("symbols"))
    return R.running_share(per, ["month"], "adopted", "symbols", "adoption")


def _themes(t: Tables):
    rows = t.commits_analysis.where("risks IS NOT NULL").select(F.lower(F.btrim("sha")).alias("sha"), F.array_join(F.array_sort(F.array_distinct(F.from_json("risks", "array<string>"))), "|").alias("theme"), "blast_radius").where("theme <> ''")
    per = rows.groupBy("theme").agg(F.countDistinct("sha").alias("commits"), F.sum("blast_radius").alias("impact"))
    first = R.first_n(rows.where("sha IS NOT NULL").select("theme", "sha").distinct(), 5, ["theme"], F.col("sha")).groupBy("theme").agg(F.array_join(F.array_sort(F.collect_list("sha")), ",").alias("sample"))  # five a theme
    return per.join(first, "theme", "left").withColumn("theme_id", F.substring(F.sha2("theme", 256), 1, 16))


def _fans(t: Tables):
    """Edges into and out of the symbols of each file; a symbol's file is the first it was changed in, edges within a file do not count."""
    home = t.change.groupBy(F.col("symbol_id").alias("dst")).agg(F.min("path").alias("home"))
    across = t.edge.join(home, "dst").where("src <> home")
    into = across.groupBy(F.col("home").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"), F.countDistinct("src").alias("callers"))
    out = across.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("fan_out"))
    return into.join(out, "path", "full_outer").na.fill(0, ["fan_in", "callers", "fan_out"])


def _merged(t: Tables):
    """Facts of both sides by identity: complete ones (with name and signature) first, then by change type, the existing side winning ties."""

    def side(rows, dna: str, n: int):
        return rows.select(F.lower(dna).alias("dna"), F.lower("change_type").alias("change_type"), "id", F.lit(n).alias("side"), (F.col("name").isNotNull() & F.col("signature").isNotNull()).alias("complete"))

    both = side(t.symbols, "dna_id", 0).unionByName(side(t.symbol_history, "symbol_dna_id", 1)).where("dna IS NOT NULL")
    of = F.col("change_type")
    prio = F.when(of == "priority_click", 3).when(of == "added", 2).when(of == "modified", 1).otherwise(0)
    return R.first_n(both.withColumn("prio", prio), 1, ["dna"], F.col("complete").desc(), F.col("prio").desc(), F.col("side"), F.col("id")).select("dna", "side", "id")


#: Sections of a repository's context in the order in which they are dropped, and the tokens that may stay.
DROP_ORDER = ["scratch_note", "glossary", "runbook", "changelog", "design_doc", "issue_report", "review_thread", "commit_log", "code_file"]
BUDGET = 4000


def _budgeted(t: Tables):
    """Sections that stay of each repository: the least important ones are dropped until the rest fits the budget."""
    rows = t.documents.where("repo IS NOT NULL AND text IS NOT NULL").select("repo", norm_source(F.col("source")).alias("section"), F.ceil(F.length("text") / 4).alias("tokens"))
    sizes = rows.where(F.col("section").isin(DROP_ORDER)).groupBy("repo", "section").agg(F.sum("tokens").alias("tokens"))
    place = F.array_position(F.array(*map(F.lit, DROP_ORDER)), F.col("section"))
    w = W.partitionBy("repo").orderBy(place.desc()).rowsBetween(W.unboundedPreceding, 0)  # a row per section
    return sizes.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= BUDGET).select("repo", "section", "used")


def _positions(t: Tables):
    params = F.filter(F.transform(F.split(F.regexp_extract("signature", r"\(([^)]*)\)", 1), ","), lambda p: F.btrim(F.regexp_extract(F.btrim(p), "^[^:=]*", 0))), lambda p: p != "")
    sigs = t.symbols.where("signature IS NOT NULL").groupBy("id").agg(F.min("signature").alias("signature"))
    at = sigs.select("id", F.posexplode(params).alias("pos", "param"))
    common = R.dominant(at, ["pos"], "param")
    off = at.join(F.broadcast(common.select("pos", "dominant")), "pos").where("param <> dominant")  # as many rows as a signature has parameters
    return off.groupBy("id").agg(F.count(F.lit(1)).alias("deviation"))


def _treemap(t: Tables):
    rows = t.symbols.where("path IS NOT NULL").select(F.regexp_replace(F.translate("path", "\\", "/"), "/{2,}", "/").alias("p"), F.col("confidence").alias("c")).select(F.regexp_replace("p", r"^(?:\./)+", "").alias("p"), F.round(F.coalesce("c", F.lit(0.0)) * 100).alias("s"))
    out = R.tree_rollup(rows.select("p", "s", F.lit(1).alias("a"), F.lit(0).alias("r")), "p", "s", "a", "r")
    return out.select("node", F.round("score", 3).alias("score"), F.col("added").cast("long").alias("added"), F.round("weight", 5).alias("weight"))


QUERIES = domain.catalogue(
    {
        "FLT-01": (lambda t: R.matching(t.change, kind="O", change_type="added", path=R.ALL, symbol_id=None).select("sha", "path", "symbol_id"), "SELECT sha, path, symbol_id FROM change WHERE kind = 'O' AND change_type = 'added'"),
        "FLT-02": (lambda t: R.search(t.symbols, "watch_r", "name", "path").select("id", "name").distinct(), "SELECT DISTINCT id, name FROM symbols WHERE name ILIKE '%watch_r%' OR path ILIKE '%watch_r%'"),
        "FLT-03": (lambda t: R.search(t.symbols, "REGISTRY", "path").select("path").distinct().orderBy("path"), "SELECT DISTINCT path FROM symbols WHERE path ILIKE '%registry%' ORDER BY path"),
        "FLT-04": (
            lambda t: R.first_n(t.files.where("path IS NOT NULL").select(F.substring_index("path", "/", 2).alias("dir"), "path").distinct(), 50, ["dir"], F.col("path")),
            "SELECT dir, path FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS dir, path FROM files WHERE path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) <= 50",
        ),
        "FLT-05": (lambda t: t.change.where(F.col("symbol_id").isin(1, 2, 3, 5, 8)).select("sha", "symbol_id"), "SELECT sha, symbol_id FROM change WHERE symbol_id IN (1, 2, 3, 5, 8)"),
        "FLT-06": (lambda t: t.symbols.where(F.col("change_type").isin("added", "modified")).select("id").distinct(), "SELECT DISTINCT id FROM symbols WHERE change_type IN ('added', 'modified')"),
        "FLT-07": (lambda t: t.symbols.where(F.col("naming_convention").isNotNull() & (F.col("naming_convention") != "unknown")).select("id", "naming_convention").distinct(), "SELECT DISTINCT id, naming_convention FROM symbols WHERE naming_convention IS NOT NULL AND naming_convention <> 'unknown'"),
        "FLT-08": (
            lambda t: t.commits_analysis.select("sha", (F.coalesce("symbols_added", F.lit(0)) + F.coalesce("symbols_removed", F.lit(0)) + F.coalesce("symbols_modified", F.lit(0))).alias("changes")),
            "SELECT sha, coalesce(symbols_added, 0) + coalesce(symbols_removed, 0) + coalesce(symbols_modified, 0) AS changes FROM commits_analysis",
        ),
        "FLT-09": (lambda t: t.change.groupBy("path").agg(F.sum(F.when(F.col("change_type") == "added", 1).otherwise(0)).alias("added"), F.count_if(F.col("kind") == "F").alias("closed")), "SELECT path, CAST(sum(CASE WHEN change_type = 'added' THEN 1 ELSE 0 END) AS BIGINT) AS added, count(*) FILTER (kind = 'F') AS closed FROM change GROUP BY path"),
        "FLT-10": (lambda t: t.change.select("path", "kind").distinct(), "SELECT DISTINCT path, kind FROM change"),
        "FLT-11": (lambda t: t.commit.where(F.col("date") >= _ts("1997-06-01")).select("sha"), "SELECT sha FROM commit WHERE date >= TIMESTAMP '1997-06-01'"),
        "FLT-12": (lambda t: t.symbol_history.where(~F.isnan("impact_score") & (F.abs("impact_score") < float("inf")) & (F.col("impact_score") >= 50)).select("id").distinct(), "SELECT DISTINCT id FROM symbol_history WHERE isfinite(impact_score) AND impact_score >= 50"),
        "FLT-13": (lambda t: t.commits_analysis.where(F.coalesce("files_changed", F.lit(0)) >= 3).select("sha").distinct(), "SELECT DISTINCT sha FROM commits_analysis WHERE coalesce(files_changed, 0) >= 3"),
        "FLT-14": (
            lambda t: R.search(R.matching(t.symbols, kind="function", change_type="modified"), "src", "path").where("load_batch BETWEEN 10 AND 40").withColumn("tags", F.split(F.concat_ws(",", "mod_reason", "naming_convention"), ",")).where(F.arrays_overlap("tags", F.array(F.lit("camelCase"), F.lit("doc_changed")))).select("id").distinct(),
            "SELECT DISTINCT id FROM symbols WHERE kind = 'function' AND change_type = 'modified' AND path ILIKE '%src%' AND load_batch BETWEEN 10 AND 40 AND (mod_reason IN ('camelCase', 'doc_changed') OR naming_convention IN ('camelCase', 'doc_changed'))",
        ),
        "FLT-15": (lambda t: t.commits_analysis.where("blast_radius > 50").select("sha", "blast_radius").distinct(), "SELECT DISTINCT sha, blast_radius FROM commits_analysis WHERE blast_radius > 50"),
        "JN-01": (lambda t: t.change.join(t.commit, "sha").select("sha", "path", "symbol_id", "author"), "SELECT sha, path, symbol_id, author FROM change JOIN commit USING (sha)"),
        "JN-02": (lambda t: t.file.join(t.commit, "sha").groupBy("author").agg(F.count(F.lit(1)).alias("files")), "SELECT author, count(*) AS files FROM file JOIN commit USING (sha) GROUP BY author"),
        "JN-03": (
            lambda t: t.symbol_versions.select(F.lower("sha").alias("sha"), F.lower("dna_id").alias("dna_id"), "id").distinct().join(t.symbols.select(F.lower("sha").alias("sha"), F.lower("dna_id").alias("dna_id"), F.col("id").alias("symbol_row"), "kind").distinct(), ["sha", "dna_id"]).select("id", "symbol_row", "kind"),
            "SELECT v.id, s.symbol_row, s.kind FROM (SELECT DISTINCT lower(sha) AS sha, lower(dna_id) AS dna_id, id FROM symbol_versions) v JOIN (SELECT DISTINCT lower(sha) AS sha, lower(dna_id) AS dna_id, id AS symbol_row, kind FROM symbols) s USING (sha, dna_id)",
        ),
        "JN-04": (
            lambda t: t.commits_metadata.select(F.lower(F.btrim("sha")).alias("sha")).distinct().join(t.commits_analysis.select(F.lower(F.btrim("sha")).alias("sha"), "status", "blast_radius").distinct(), "sha", "left"),
            "SELECT sha, status, blast_radius FROM (SELECT DISTINCT lower(trim(sha)) AS sha FROM commits_metadata) LEFT JOIN (SELECT DISTINCT lower(trim(sha)) AS sha, status, blast_radius FROM commits_analysis) USING (sha)",
        ),
        "JN-05": (
            lambda t: t.commit.join(t.change.where("kind = 'O'"), "sha", "left").groupBy("sha").agg(F.count("symbol_id").alias("symbols"), F.sum(F.when(F.col("change_type") == "added", 1).otherwise(0)).alias("added")),
            "SELECT sha, count(symbol_id) AS symbols, CAST(sum(CASE WHEN change_type = 'added' THEN 1 ELSE 0 END) AS BIGINT) AS added FROM commit LEFT JOIN (SELECT * FROM change WHERE kind = 'O') USING (sha) GROUP BY sha",
        ),
        "JN-06": (
            lambda t: t.symbols.select("id", F.lower("sha").alias("sha"), "symbol_id", "path").distinct().join(t.symbol_versions.select(F.lower("sha").alias("sha"), "symbol_id", "path", "dna_id").distinct(), ["sha", "symbol_id", "path"], "left").select("id", F.coalesce("dna_id", "symbol_id").alias("key")),
            "SELECT id, coalesce(dna_id, symbol_id) AS key FROM (SELECT DISTINCT id, lower(sha) AS sha, symbol_id, path FROM symbols) LEFT JOIN (SELECT DISTINCT lower(sha) AS sha, symbol_id, path, dna_id FROM symbol_versions) USING (sha, symbol_id, path)",
        ),
        "JN-07": (lambda t: t.commit.join(t.change.where("kind = 'F'"), "sha", "left_anti").select("sha"), "SELECT sha FROM commit c WHERE NOT EXISTS (SELECT 1 FROM change b WHERE b.sha = c.sha AND kind = 'F')"),
        "JN-08": (
            lambda t: t.change.select("symbol_id").distinct().join(t.change.join(F.broadcast(t.commit.orderBy(F.col("date").desc(), F.col("sha").desc()).limit(10)), "sha", "left_semi"), "symbol_id", "left_anti"),
            "SELECT DISTINCT symbol_id FROM change WHERE symbol_id NOT IN (SELECT symbol_id FROM change WHERE sha IN (SELECT sha FROM commit ORDER BY date DESC, sha DESC LIMIT 10))",
        ),
        "JN-09": (
            lambda t: t.part.select(F.col("p_partkey").alias("path")).join(t.file.join(t.commit, "sha").groupBy("path").agg(F.min("date").alias("created")), "path", "left").select("path", F.coalesce("created", _ts(domain.AS_OF)).alias("created_at")),
            f"SELECT p_partkey AS path, coalesce(created, TIMESTAMP '{domain.AS_OF}') AS created_at FROM part LEFT JOIN (SELECT path, min(date) AS created FROM file JOIN commit USING (sha) GROUP BY path) ON path = p_partkey",
        ),
        "JN-10": (
            _same_body,
            ", r AS (SELECT DISTINCT lower(body_hash) AS h, id, name, load_batch FROM symbol_versions WHERE body_hash IS NOT NULL), p AS (SELECT o.id AS a, n.id AS b, o.name = n.name AS same FROM r o JOIN r n USING (h) WHERE o.load_batch <= 20 AND n.load_batch > 20) SELECT a, b, CASE WHEN same THEN 1.0 ELSE 0.9 END::DOUBLE AS score FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY coalesce(same, false) DESC, b) = 1",
        ),
        "JN-11": (
            _best_match,
            """, r AS (SELECT DISTINCT lower(trim(sha)) AS sha, kind, id AS old_id, name AS old_name FROM symbols WHERE change_type = 'removed' AND name IS NOT NULL), a AS (SELECT DISTINCT lower(trim(sha)) AS sha, kind, id AS new_id, name AS new_name FROM symbols WHERE change_type = 'added' AND name IS NOT NULL),
            p AS (SELECT old_id, new_id, round((greatest(length(old_name), length(new_name)) - levenshtein(old_name, new_name)) / greatest(length(old_name), length(new_name)), 6) AS score FROM r JOIN a USING (sha, kind))
            SELECT * FROM p WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY score DESC, new_id) = 1""",
        ),
        "JN-12": (
            _moved_names,
            "SELECT a, min(b) AS b FROM (SELECT DISTINCT name, kind, path AS old_path, id AS a FROM symbols WHERE change_type = 'removed') JOIN (SELECT DISTINCT name, kind, path AS new_path, id AS b FROM symbols WHERE change_type = 'added') USING (name, kind) WHERE old_path <> new_path GROUP BY a",
        ),
        "JN-13": (
            lambda t: R.diff(t.change.where("kind = 'F'").groupBy("path").agg(F.max("symbol_id").alias("v")), t.change.where("kind = 'O'").groupBy("path").agg(F.max("symbol_id").alias("v")), ["path"], "v"),
            "SELECT path, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'modified' END AS state FROM (SELECT path, max(symbol_id) AS v FROM change WHERE kind = 'F' GROUP BY path) a FULL JOIN (SELECT path, max(symbol_id) AS v FROM change WHERE kind = 'O' GROUP BY path) b USING (path)",
        ),
        "JN-14": (
            lambda t: R.one_to_one(t.symbols.where("change_type = 'removed'").select(F.lower("dna_id").alias("dna"), F.col("id").alias("a")).distinct(), t.symbols.where("change_type = 'added'").select(F.lower("dna_id").alias("dna"), F.col("id").alias("b")).distinct(), ["dna"], "a", "b"),
            ", r AS (SELECT dna, a, row_number() OVER (PARTITION BY dna ORDER BY a) AS k FROM (SELECT DISTINCT lower(dna_id) AS dna, id AS a FROM symbols WHERE change_type = 'removed')), s AS (SELECT dna, b, row_number() OVER (PARTITION BY dna ORDER BY b) AS k FROM (SELECT DISTINCT lower(dna_id) AS dna, id AS b FROM symbols WHERE change_type = 'added')) SELECT dna, a, b FROM r JOIN s USING (dna, k)",
        ),
        "JN-15": (
            lambda t: t.symbols.select("id", "name").distinct().join(R.unique_names(t.symbol_versions.where("name IS NOT NULL").select("name", F.lower("dna_id").alias("dna")), "name", "dna"), "name", "left").select("id", "dna"),
            "SELECT id, dna FROM (SELECT DISTINCT id, name FROM symbols) LEFT JOIN (SELECT name, min(lower(dna_id)) AS dna FROM symbol_versions WHERE name IS NOT NULL GROUP BY name HAVING count(DISTINCT lower(dna_id)) = 1) USING (name)",
        ),
        "JN-16": (
            _two_stage,
            "SELECT w.id, coalesce(k.i, n.i) AS found_id FROM (SELECT DISTINCT id, lower(dna_id) AS dna, name, path FROM symbol_versions) w LEFT JOIN (SELECT lower(dna_id) AS dna, min(id) AS i FROM symbols GROUP BY 1) k ON k.dna = w.dna LEFT JOIN (SELECT name, path, min(id) AS i FROM symbols GROUP BY ALL) n ON n.name = w.name AND n.path = w.path",
        ),
        "JN-17": (_enriched, "SELECT path, count(*) AS changes, CAST(sum(lines) AS BIGINT) AS churn FROM change GROUP BY path ORDER BY changes DESC, path LIMIT 100"),
        "JN-18": (_zero_filled, "SELECT p_partkey AS path, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT path, count(*) AS n FROM change WHERE change_type = 'removed' GROUP BY path) ON path = p_partkey WHERE p_size <= 10"),
        "JN-19": (
            lambda t: t.commit.select("sha", "author", F.lag("sha").over(W.partitionBy("author").orderBy("date", "sha")).alias("prior")).join(t.commit.select(F.col("sha").alias("prior"), F.col("message").alias("prior_message")), "prior", "left").select("sha", "prior", "prior_message"),
            ", c AS (SELECT sha, lag(sha) OVER (PARTITION BY author ORDER BY date, sha) AS prior FROM commit) SELECT c.sha, c.prior, p.message AS prior_message FROM c LEFT JOIN commit p ON p.sha = c.prior",
        ),
        "AG-01": (lambda t: t.change.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM change"),
        "AG-02": (lambda t: t.change.agg(F.countDistinct("path").alias("paths"), F.countDistinct("symbol_id").alias("symbols")), "SELECT count(DISTINCT path) AS paths, count(DISTINCT symbol_id) AS symbols FROM change"),
        "AG-03": (lambda t: t.symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "kind").limit(5), "SELECT kind, count(*) AS n FROM symbols GROUP BY kind ORDER BY n DESC, kind NULLS FIRST LIMIT 5"),
        "AG-04": (
            lambda t: t.change.join(t.commit, "sha").groupBy("symbol_id").agg(F.countDistinct("sha").alias("n"), F.max("date").alias("last"), F.max_by("message", F.struct("date", "sha")).alias("message")).where("n >= 2").withColumn("risk", F.least(F.col("n") / 5, F.lit(1.0))),
            "SELECT symbol_id, count(DISTINCT sha) AS n, max(date) AS last, arg_max(message, (date, sha)) AS message, least(count(DISTINCT sha) / 5, 1.0) AS risk FROM change JOIN commit USING (sha) GROUP BY symbol_id HAVING n >= 2",
        ),
        "AG-05": (lambda t: t.file.join(t.commit, "sha").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last")).orderBy(F.col("n").desc(), "path").limit(10), "SELECT path, count(*) AS n, max(date) AS last FROM file JOIN commit USING (sha) GROUP BY path ORDER BY n DESC, path LIMIT 10"),
        "AG-06": (lambda t: R.first_n(t.change.groupBy("kind", "symbol_id").agg(F.count(F.lit(1)).alias("n")), 5, ["kind"], F.col("n").desc(), F.col("symbol_id")), "SELECT kind, symbol_id, count(*) AS n FROM change GROUP BY kind, symbol_id QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, symbol_id) <= 5"),
        "AG-07": (
            lambda t: t.edge.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in")).join(t.edge.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out")), "id", "full_outer").na.fill(0),
            "SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM (SELECT dst AS id, count(*) AS fan_in FROM edge GROUP BY dst) FULL JOIN (SELECT src AS id, count(*) AS fan_out FROM edge GROUP BY src) USING (id)",
        ),
        "AG-08": (
            _fans,
            """, home AS (SELECT symbol_id, min(path) AS home FROM change GROUP BY symbol_id), x AS (SELECT src, home FROM edge JOIN home ON dst = symbol_id WHERE src <> home),
            i AS (SELECT home AS path, count(*) AS fan_in, count(DISTINCT src) AS callers FROM x GROUP BY home), o AS (SELECT src AS path, count(*) AS fan_out FROM x GROUP BY src)
            SELECT path, coalesce(fan_in, 0) AS fan_in, coalesce(callers, 0) AS callers, coalesce(fan_out, 0) AS fan_out FROM i FULL JOIN o USING (path)""",
        ),
        "AG-09": (
            lambda t: R.first_n(t.file.join(t.commit, "sha").groupBy("path", "author").agg(F.count(F.lit(1)).alias("n")), 3, ["path"], F.col("n").desc(), F.col("author")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "author"))), lambda x: x["author"].cast("string")), ",").alias("authors")),
            "SELECT path, string_agg(CAST(author AS VARCHAR), ',' ORDER BY n DESC, author) AS authors FROM (SELECT path, author, count(*) AS n FROM file JOIN commit USING (sha) GROUP BY path, author QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, author) <= 3) GROUP BY path",
        ),
        "AG-10": (
            lambda t: t.file.join(t.commit, "sha").groupBy("path").agg(F.min("date").alias("first"), F.max("date").alias("last")).select("path", F.floor((F.unix_micros(_ts(domain.AS_OF)) - F.unix_micros("first")) / _DAY).alias("age_days"), "last"),
            f"SELECT path, CAST(floor((epoch_us(TIMESTAMP '{domain.AS_OF}') - epoch_us(min(date))) / {_DAY}) AS BIGINT) AS age_days, max(date) AS last FROM file JOIN commit USING (sha) GROUP BY path",
        ),
        "AG-11": (
            _commit_fold,
            ", top AS (SELECT sha, lines FROM change QUALIFY row_number() OVER (PARTITION BY sha ORDER BY lines DESC, symbol_id, path) <= 10) SELECT sha, CAST(sum(lines) AS BIGINT) AS lines, max(discount) AS structural, string_agg(DISTINCT kind, '|' ORDER BY kind) AS risks, (SELECT CAST(sum(lines) AS BIGINT) FROM top WHERE top.sha = change.sha) AS top_impact FROM change GROUP BY sha",
        ),
        "AG-12": (
            lambda t: t.symbols.where("mod_reason IS NOT NULL AND mod_reason <> '' AND kind IS NOT NULL AND kind <> ''").groupBy(F.concat_ws("|", "kind", "mod_reason").alias("grp")).agg(F.count(F.lit(1)).alias("n")),
            "SELECT kind || '|' || mod_reason AS grp, count(*) AS n FROM symbols WHERE mod_reason <> '' AND kind <> '' GROUP BY 1",
        ),
        "AG-13": (
            lambda t: R.best_of_group(t.symbol_history.where("symbol_dna_id IS NOT NULL").select(F.lower(F.btrim("symbol_dna_id")).alias("dna"), "id", "impact_score").distinct(), "dna", "impact_score", "id", 20.0).select("dna", "id"),
            ", h AS (SELECT DISTINCT lower(trim(symbol_dna_id)) AS dna, id, CASE WHEN isnan(impact_score) THEN NULL ELSE impact_score END AS s FROM symbol_history WHERE symbol_dna_id IS NOT NULL), k AS (SELECT *, count(*) OVER (PARTITION BY dna) AS n, row_number() OVER (PARTITION BY dna ORDER BY s DESC NULLS LAST, id) AS rn FROM h) SELECT dna, id FROM k WHERE rn = 1 AND (n = 1 OR s IS NULL OR s >= 20)",
        ),
        "AG-14": (
            lambda t: t.commits_analysis.select("sha", F.round(F.least(F.greatest((F.coalesce("structural_change_score", F.lit(0.0)) * 3 + F.coalesce(F.col("blast_radius") / 100, F.lit(0.0)) * 1) / 4, F.lit(0.0)), F.lit(1.0)), 6).alias("score")),
            "SELECT sha, round(least(greatest((coalesce(structural_change_score, 0.0) * 3 + coalesce(blast_radius / 100, 0.0) * 1) / 4, 0.0), 1.0), 6) AS score FROM commits_analysis",
        ),
        "AG-15": (
            lambda t: R.first_n(t.change.select("path", "sha", "symbol_id"), 3, ["path"], F.col("sha"), F.col("symbol_id")).groupBy("path").agg(F.count(F.lit(1)).alias("kept")).orderBy(F.col("kept").desc(), "path"),
            "SELECT path, least(count(*), 3) AS kept FROM change GROUP BY path ORDER BY kept DESC, path",
        ),
        "AG-16": (
            lambda t: t.change.join(t.commit.where((F.col("date") >= _ts("1998-05-01")) & (F.col("status") != "P")), "sha").groupBy("path").agg(F.countDistinct("sha").alias("commits"), F.sum(F.when(F.col("change_type") == "added", F.col("lines")).otherwise(0)).cast("long").alias("added"), F.sum(F.when(F.col("change_type") == "removed", F.col("lines")).otherwise(0)).cast("long").alias("removed")).join(t.part.select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size")), "path", "left").orderBy(F.col("commits").desc(), "path"),
            "SELECT path, count(DISTINCT sha) AS commits, CAST(sum(CASE change_type WHEN 'added' THEN lines ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE change_type WHEN 'removed' THEN lines ELSE 0 END) AS BIGINT) AS removed, any_value(p_size) AS size FROM change JOIN commit USING (sha) LEFT JOIN part ON p_partkey = path WHERE date >= TIMESTAMP '1998-05-01' AND status <> 'P' GROUP BY path",
        ),
        "AG-17": (
            lambda t: R.dominant(t.symbols.where("path IS NOT NULL AND naming_convention IS NOT NULL"), ["path"], "naming_convention", ["camelCase", "PascalCase", "snake_case", "SCREAMING_SNAKE", "kebab-case", "mixed"]),
            ", c AS (SELECT path, naming_convention, count(*) AS n FROM symbols WHERE path IS NOT NULL AND naming_convention IS NOT NULL GROUP BY ALL) SELECT path, naming_convention AS dominant, n FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, coalesce(list_position(['camelCase', 'PascalCase', 'snake_case', 'SCREAMING_SNAKE', 'kebab-case', 'mixed'], naming_convention), 1000000), naming_convention) = 1",
        ),
        "AG-18": (lambda t: t.change.where("change_type = 'removed' AND kind = 'O'").groupBy("path").agg(F.count(F.lit(1)).alias("drift")).orderBy(F.col("drift").desc(), "path").limit(10), "SELECT path, count(*) AS drift FROM change WHERE change_type = 'removed' AND kind = 'O' GROUP BY path ORDER BY drift DESC, path LIMIT 10"),
        "AG-19": (
            lambda t: t.symbols.agg(F.count_if(F.col("change_type").isin("added", "modified", "renamed")).alias("present"), F.count_if(F.col("change_type") == "removed").alias("absent"), F.count_if(F.col("change_type") == "renamed").alias("renamed")),
            "SELECT count(*) FILTER (change_type IN ('added', 'modified', 'renamed')) AS present, count(*) FILTER (change_type = 'removed') AS absent, count(*) FILTER (change_type = 'renamed') AS renamed FROM symbols",
        ),
        "AG-20": (lambda t: t.symbols.where("path IS NOT NULL").groupBy("path").agg(F.countDistinct("naming_convention").alias("styles")).where("styles > 1"), "SELECT path, count(DISTINCT naming_convention) AS styles FROM symbols WHERE path IS NOT NULL GROUP BY path HAVING styles > 1"),
        "AG-21": (
            _positions,
            r""", s AS (SELECT id, list_filter(list_transform(string_split(regexp_extract(min(signature), '\(([^)]*)\)', 1), ','), lambda p: trim(regexp_extract(trim(p), '^[^:=]*'))), lambda p: p <> '') AS ps FROM symbols WHERE signature IS NOT NULL GROUP BY id),
            e AS (SELECT id, unnest(ps) AS param, unnest(range(len(ps))) AS pos FROM s), d AS (SELECT pos, param AS dom FROM (SELECT pos, param, count(*) AS n FROM e GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC, param) = 1)
            SELECT id, count(*) AS deviation FROM e JOIN d USING (pos) WHERE param <> dom GROUP BY id""",
        ),
        "AG-22": (
            _themes,
            """, r AS (SELECT lower(trim(sha)) AS sha, array_to_string(list_sort(list_distinct(CAST(CAST(risks AS JSON) AS VARCHAR[]))), '|') AS theme, blast_radius FROM commits_analysis WHERE risks IS NOT NULL AND json_valid(risks))
            SELECT theme, count(DISTINCT sha) AS commits, CAST(sum(blast_radius) AS BIGINT) AS impact, array_to_string(list_sort(list(DISTINCT sha))[1:5], ',') AS sample, sha256(theme)[1:16] AS theme_id FROM r WHERE theme <> '' GROUP BY theme""",
        ),
        "AG-23": (
            _treemap,
            """, f AS (SELECT regexp_replace(regexp_replace(replace(path, chr(92), '/'), '/+', '/', 'g'), '^(\\./)+', '') AS p, round(coalesce(confidence, 0.0) * 100) AS s FROM symbols WHERE path IS NOT NULL),
            x AS (SELECT string_split(p, '/') AS a, p, s FROM f), e AS (SELECT array_to_string(a[1:n], '/') AS node, n AS depth, CASE WHEN n = len(a) THEN s ELSE 0.0 END AS own FROM (SELECT a, s, unnest(range(1, len(a) + 1)) AS n FROM x)),
            nodes AS (SELECT node, depth, sum(own) AS own, count(*) AS added, CASE WHEN depth > 1 THEN array_to_string(string_split(node, '/')[1:depth - 1], '/') END AS up FROM e GROUP BY node, depth),
            top AS (SELECT max(depth) AS d FROM nodes),
            lv AS (SELECT node, depth, up, own AS score FROM nodes WHERE depth = (SELECT d FROM top) UNION ALL
              SELECT n.node, n.depth, n.up, greatest(n.own, coalesce(k.s, 0.0)) FROM (SELECT max(depth) - 1 AS depth FROM lv) q JOIN nodes n ON n.depth = q.depth LEFT JOIN (SELECT up, sum(score) AS s FROM lv GROUP BY up) k ON k.up = n.node)
            SELECT node, round(score, 3) AS score, added, round(greatest(score / (SELECT max(score) FROM lv), 0.05), 5)::DOUBLE AS weight FROM lv JOIN nodes USING (node, depth)""",
        ),
        "AG-24": (
            lambda t: t.edge.select(F.format_string("%s -> %s (%s)", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("edge_type")).alias("e")).select(F.regexp_extract("e", r"^(.*) -> (.*) \((\w+)\)$", 2).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("refs")),
            "SELECT CAST(dst AS VARCHAR) AS target, count(*) AS refs FROM edge GROUP BY dst",
        ),
        "AG-25": (
            lambda t: t.orders.groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).count().select("o_orderstatus", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("3-MEDIUM").alias("medium")).na.fill(0),
            "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS medium FROM orders GROUP BY o_orderstatus",
        ),
        "WN-01": (lambda t: R.first_n(t.change.join(t.commit.select("sha", "date"), "sha").select("symbol_id", "sha", "path", "date"), 1, ["symbol_id"], F.col("date").desc(), F.col("sha").desc(), F.col("path")), "SELECT symbol_id, sha, path, date FROM change JOIN commit USING (sha) QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY date DESC, sha DESC, path) = 1"),
        "WN-02": (lambda t: t.change.join(t.commit, "sha").groupBy("path").agg(F.max_by("sha", F.struct("date", "sha")).alias("sha")), "SELECT path, arg_max(sha, (date, sha)) AS sha FROM change JOIN commit USING (sha) GROUP BY path"),
        "WN-03": (
            _adoption,
            ", m AS (SELECT strftime(date, '%Y-%m') AS month, count(*) FILTER (kind = 'O') AS adopted, count(kind) AS symbols FROM commit LEFT JOIN change USING (sha) GROUP BY 1) SELECT *, round(100 * sum(adopted) OVER w / nullif(sum(symbols) OVER w, 0), 4) AS adoption FROM m WINDOW w AS (ORDER BY month)",
        ),
        "WN-04": (
            lambda t: t.events.select("event_id", F.round((F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(W.partitionBy("user_id").orderBy("ts", "event_id"))) / _DAY, 6).alias("gap_days")),
            f"SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / {_DAY}, 6) AS gap_days FROM events",
        ),
        "WN-05": (lambda t: R.first_n(t.events.select("user_id", "event_id", "ts"), 3, ["user_id"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id"), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3"),
        "WN-06": (lambda t: t.symbols.where("path IS NOT NULL").groupBy("path").agg(F.max_by("confidence", "id").alias("confidence")), "SELECT path, arg_max_null(confidence, id) AS confidence FROM symbols WHERE path IS NOT NULL GROUP BY path"),
        "WN-07": (lambda t: t.events.select("event_id", (F.count(F.lit(1)).over(W.partitionBy("user_id")) - F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("versions_ago")), "SELECT event_id, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS versions_ago FROM events"),
        "WN-08": (lambda t: t.events.select("event_id", F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_id")), "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events"),
        "WN-09": (lambda t: R.first_n(t.change.select("path", "symbol_id", "lines", "sha"), 1, ["path"], F.col("lines").desc(), F.col("sha"), F.col("symbol_id")), "SELECT path, symbol_id, lines, sha FROM change QUALIFY row_number() OVER (PARTITION BY path ORDER BY lines DESC, sha, symbol_id) = 1"),
        "SO-01": (lambda t: t.commit.orderBy(F.col("size").desc(), "sha").limit(20).select("sha", "size"), "SELECT sha, size FROM commit ORDER BY size DESC, sha LIMIT 20"),
        "SO-02": (lambda t: t.commit.orderBy("status", F.col("date").desc(), "sha").select("sha", "status", "date"), "SELECT sha, status, date FROM commit ORDER BY status, date DESC, sha"),
        "SO-03": (lambda t: t.commit.orderBy(F.col("date").desc(), "sha").offset(40).limit(20).select("sha", "date"), "SELECT sha, date FROM commit ORDER BY date DESC, sha LIMIT 20 OFFSET 40"),
        "SO-04": (
            lambda t: t.commit.withColumn("rank", F.create_map(*(F.lit(x) for pair in (("1-URGENT", 0), ("2-HIGH", 1), ("3-MEDIUM", 2)) for x in pair))[F.col("message")]).select("sha", F.coalesce("rank", F.lit(9)).alias("rank")).orderBy("rank", "sha"),
            "SELECT sha, CASE message WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 9 END AS rank FROM commit ORDER BY rank, sha",
        ),
        "SO-05": (lambda t: R.first_n(t.commit.select("message", "sha", "size"), 30, ["message"], F.col("size").desc(), F.col("sha")), "SELECT message, sha, size FROM commit QUALIFY row_number() OVER (PARTITION BY message ORDER BY size DESC, sha) <= 30"),
        "SO-06": (
            _budgeted,
            f""", s AS (SELECT repo, replace(lower(trim(source)), '-', '_') AS section, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens FROM documents WHERE repo IS NOT NULL AND text IS NOT NULL GROUP BY ALL)
            SELECT repo, section, CAST(sum(tokens) OVER (PARTITION BY repo ORDER BY list_position({DROP_ORDER}, section) DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM s WHERE list_contains({DROP_ORDER}, section) QUALIFY used <= {BUDGET}""",
        ),
        "ST-01": (lambda t: t.orders.select(F.col("o_orderdate").cast("timestamp").alias("date"), F.lit("order").alias("origin")).unionByName(t.lineitem.select(F.col("l_shipdate").cast("timestamp").alias("date"), F.lit("ship").alias("origin"))).groupBy("date", "origin").agg(F.count(F.lit(1)).alias("n")).orderBy("date", "origin"), "SELECT date, origin, count(*) AS n FROM (SELECT o_orderdate AS date, 'order' AS origin FROM orders UNION ALL SELECT l_shipdate, 'ship' FROM lineitem) GROUP BY ALL"),
        "ST-02": (lambda t: t.change.where("kind = 'O'").select("path").union(t.change.where("change_type = 'added'").select("path")).distinct(), "SELECT path FROM change WHERE kind = 'O' UNION SELECT path FROM change WHERE change_type = 'added'"),
        "ST-03": (
            lambda t: t.change.where("kind = 'O'").select("path", "symbol_id").distinct().join(t.change.where("kind = 'F'").select("path", "symbol_id"), ["path", "symbol_id"], "left_anti"),
            "SELECT path, symbol_id FROM change WHERE kind = 'O' EXCEPT SELECT path, symbol_id FROM change WHERE kind = 'F'",
        ),
        "ST-04": (
            lambda t: t.change.groupBy("path", "symbol_id").agg(F.max(F.col("kind") == "O").alias("a"), F.max(F.col("kind") == "F").alias("b")).groupBy("path").agg(F.round(F.count_if(F.col("a") & F.col("b")) / F.count(F.lit(1)), 6).alias("jaccard")),
            ", g AS (SELECT path, symbol_id, bool_or(kind = 'O') AS a, bool_or(kind = 'F') AS b FROM change GROUP BY ALL) SELECT path, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard FROM g GROUP BY path",
        ),
        "ST-05": (
            _merged,
            """, u AS (SELECT lower(dna_id) AS dna, lower(change_type) AS change_type, id, 0 AS side, name IS NOT NULL AND signature IS NOT NULL AS complete FROM symbols UNION ALL SELECT lower(symbol_dna_id), lower(change_type), id, 1, name IS NOT NULL AND signature IS NOT NULL FROM symbol_history)
            SELECT dna, side, id FROM u WHERE dna IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dna ORDER BY complete DESC, CASE change_type WHEN 'priority_click' THEN 3 WHEN 'added' THEN 2 WHEN 'modified' THEN 1 ELSE 0 END DESC, side, id) = 1""",
        ),
        "ST-06": (
            lambda t: t.change.where("kind = 'O'").groupBy("path").agg(F.max("lines").alias("score")).withColumn("side", F.lit(0)).unionByName(t.change.where("kind = 'F'").groupBy("path").agg(F.max("lines").alias("score")).withColumn("side", F.lit(1))).groupBy("path").agg(F.max(F.struct("score", (-F.col("side")).alias("s"))).alias("b")).select("path", F.col("b.score").alias("score"), (-F.col("b.s")).alias("side")),
            ", s AS (SELECT path, max(lines) AS score, 0 AS side FROM change WHERE kind = 'O' GROUP BY path UNION ALL SELECT path, max(lines), 1 FROM change WHERE kind = 'F' GROUP BY path) SELECT path, score, side FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, side) = 1",
        ),
    }
)
