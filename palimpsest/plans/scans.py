"""Sources and sinks (SRC, SNK)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import norm_path
from ..operators import upserts
from ..session import Cut
from ..sources import parsers
from . import domain
from .domain import Tables

_NORM = "regexp_replace(regexp_replace(replace({}, chr(92), '/'), '/+', '/', 'g'), '^(\\./)+', '')"
_CODE = "text IS NOT NULL AND lower(trim(source)) IN ('code_file', 'code-file')"


def numstat_lines(t: Tables):
    """A numstat listing per commit: a header line ``commit <sha>`` and then ``added removed path`` lines."""
    stat = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), F.concat_ws("\t", F.when(F.col("l_discount") == 0, F.lit("-")).otherwise(F.col("l_quantity").cast("long").cast("string")), F.col("l_suppkey").cast("string"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("line"))
    head = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("n"), F.concat(F.lit("commit "), F.col("o_orderkey").cast("string")).alias("line"))
    return stat.unionByName(head)


NUMSTAT = """, stat AS (SELECT l_orderkey AS sha, CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS added, l_suppkey AS removed, 'p' || l_partkey AS path FROM lineitem) """


def stat_history(t: Tables):
    rows = numstat_lines(t).withColumn("author", F.col("l_orderkey") % 8)  # eight logs, read side by side
    order = F.struct("l_orderkey", "n", "line")
    filled = parsers.fill_header(rows.withColumn("pos", order), F.col("line").startswith("commit "), F.substring("line", 8, 20).cast("long"), "author", "pos", "sha")
    stats = parsers.numstat(filled.where(~F.col("line").startswith("commit ")))
    return stats.groupBy("sha").agg(F.sum("added").alias("additions"), F.sum("removed").alias("deletions"), F.count(F.lit(1)).alias("files"))


def first_seen(t: Tables):
    return upserts.insert_absent(t.symbol_versions.where("load_batch <= 30").select(F.lower("dna_id").alias("dna_id")), t.symbol_versions.where("load_batch > 30").select(F.lower("dna_id").alias("dna_id"), "id", "sha"), ["dna_id"], "id")


def markdown(t: Tables):
    """Report with a title, totals, the ten largest commits and the ten most changed files; written as text and read back with its order."""
    commits, changes = t.commit.agg(F.count(F.lit(1)).alias("n")), t.change.agg(F.count(F.lit(1)).alias("n"))
    title = t.spark.createDataFrame([(1, 0, "# Change report"), (4, 0, "## Largest commits"), (6, 0, "## Most changed files")], "section int, rank long, line string")
    totals = commits.select(F.lit(2).alias("section"), F.lit(0).cast("long").alias("rank"), F.format_string("Commits: %d", "n").alias("line")).unionByName(changes.select(F.lit(3).alias("section"), F.lit(0).cast("long").alias("rank"), F.format_string("Changed symbols: %d", "n").alias("line")))
    top = t.commit.orderBy(F.col("size").desc(), "sha").limit(10).select(F.lit(5).alias("section"), F.row_number().over(W.orderBy(F.col("size").desc(), "sha")).cast("long").alias("rank"), F.format_string("- **%s** by %s: %s", F.col("sha").cast("string"), F.col("author").cast("string"), F.col("message")).alias("line"))
    files = t.change.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "path").limit(10)
    files = files.select(F.lit(7).alias("section"), F.row_number().over(W.orderBy(F.col("n").desc(), "path")).cast("long").alias("rank"), F.format_string("- %s: %d changes", F.col("path").cast("string"), "n").alias("line"))
    path = f"{Cut(t.spark, 'report').base}/report"
    lines = title.unionByName(totals).unionByName(top).unionByName(files)
    lines.coalesce(1).sortWithinPartitions("section", "rank").select("line").write.text(path)  # some thirty lines
    return t.spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("n", "line")).select(F.col("n").cast("long").alias("n"), "line")


#: Marks between the records and fields of a log, as a log command writes them on demand.
RECORD, FIELD = "\x1e", "\x1f"


def commit_log(t: Tables):
    """A log file of the commits, written and read back as text: one record a commit, its fields between marks."""
    clean = [F.coalesce(F.regexp_replace(c, "[\x1e\x1f]", " "), F.lit("")) for c in ("sha", "author", "date", "message", "parent")]
    path = f"{Cut(t.spark, 'log').base}/commits"
    t.commits_metadata.select(F.concat_ws(FIELD, *clean).alias("value")).write.option("lineSep", RECORD).text(path)
    return parsers.log_records(t.spark.read.option("lineSep", RECORD).text(path), FIELD)


def blame(t: Tables):
    """Line to commit: the newest symbol change of the line's number in the line's file."""
    ranges = t.change.join(t.commit, "sha").select("path", F.col("lines").cast("long").alias("line_no"), "sha", "author", "date")
    return upserts.latest(ranges, ["path", "line_no"], F.col("date").desc(), F.col("sha").desc()).select("path", "line_no", "sha", "author")


def workspace(t: Tables):
    """Porcelain status lines of the changed files, parsed: the first letter is the staged state, the second the unstaged one."""
    letter = F.upper(F.substring("status", 1, 1))
    at = F.when(F.col("load_batch") == F.max("load_batch").over(W.partitionBy("path")), F.lit("now")).otherwise("before")
    rows = t.files.where("path IS NOT NULL AND status IS NOT NULL").select("path", letter.alias("letter"), at.alias("at")).groupBy("path").agg(F.coalesce(F.max(F.when(F.col("at") == "before", F.col("letter"))), F.lit(" ")).alias("x"), F.max(F.when(F.col("at") == "now", F.col("letter"))).alias("y"))
    return parsers.status_lines(rows.select(F.concat("x", "y", F.lit(" "), "path").alias("line")))


def blobs(t: Tables):
    """Texts by blob hash: each distinct content once, and the documents that have it."""
    keyed = t.documents.where("text IS NOT NULL").select("doc_id", F.sha1(F.encode("text", "utf-8")).alias("blob"), F.octet_length("text").cast("long").alias("size"))
    cached = keyed.groupBy("blob").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("documents"))
    return keyed.select("doc_id", "blob").join(cached, "blob")


def appended(t: Tables):
    """Two batches appended to one table."""
    path = f"{Cut(t.spark, 'append').base}/history"
    for kind in ("added", "removed"):
        t.symbol_history.where(F.col("change_type") == kind).select("id", "name").write.mode("append").parquet(path)
    return t.spark.read.schema("id long, name string").parquet(path)


def facts_file(t: Tables):
    """Facts written as JSON lines and read back as text."""
    path = f"{Cut(t.spark, 'facts').base}/facts"
    t.commit.select("author", "message", "sha").write.json(path)
    return t.spark.read.text(path).select(F.get_json_object("value", "$.sha").cast("long").alias("sha"), F.col("value").alias("fact"))


def gated(t: Tables):
    """Documents with a path that pass the source gate: path, size, and not on the ignore list (paths deleted by a commit)."""
    docs = t.documents.where("file_path IS NOT NULL").select("doc_id", norm_path(F.col("file_path")).alias("path"), F.octet_length("text").alias("size"))
    ignored = t.files.where("upper(status) = 'D' AND path IS NOT NULL").select(norm_path(F.col("path")).alias("path")).distinct()
    return docs.join(ignored, "path", "left_anti").where(parsers.processable(F.col("path"), F.col("size"))).select("doc_id", "path")


def mermaid(t: Tables):
    """Graph text: edges of confidence above 0.5, the most certain 40 (twice the node limit of 20), one line each."""
    top = t.edge.where("confidence > 0.5").orderBy(F.col("confidence").desc(), "src", "dst", "edge_type").limit(40)
    line = F.format_string("  n%s -->|%s| n%s", F.col("src").cast("string"), F.col("edge_type"), F.col("dst").cast("string"))
    return top.select(F.struct(F.col("confidence").alias("c"), line.alias("line")).alias("x")).agg(F.array_sort(F.collect_list("x.line")).alias("l")).select(F.concat(F.lit("graph LR\n"), F.array_join("l", "\n")).alias("graph"))


QUERIES = domain.catalogue(
    {
        "SRC-01": (lambda t: t.supplier, "SELECT * FROM supplier"),
        "SRC-02": (lambda t: t.commit.where("sha = 7").select("sha", "author", "message"), "SELECT sha, author, message FROM commit WHERE sha = 7"),
        "SRC-03": (lambda t: t.commit.join(t.change, "sha", "left_semi").select("sha"), "SELECT sha FROM commit WHERE sha IN (SELECT sha FROM change)"),
        "SRC-04": (
            lambda t: t.commit.join(t.file.where(F.col("path").isin(list(range(1, 201)))).select("sha"), "sha", "left_semi").select("sha", "author"),
            f"SELECT sha, author FROM commit WHERE sha IN (SELECT sha FROM file WHERE path IN ({', '.join(map(str, range(1, 201)))}))",
        ),
        "SRC-05": (
            commit_log,
            "SELECT coalesce(sha, '') AS sha, coalesce(author, '') AS author, coalesce(date, '') AS date, coalesce(message, '') AS message, coalesce(parent, '') AS parent FROM commits_metadata",
        ),
        "SRC-06": (
            lambda t: parsers.name_status(t.files.where("path IS NOT NULL AND status IS NOT NULL").select("id", F.concat_ws("\t", F.when(F.upper("status").isin("R", "C"), F.concat(F.upper("status"), F.lit("100"))).otherwise(F.upper("status")), F.when(F.upper("status").isin("R", "C"), F.concat(F.lit("old/"), "path")), F.col("path")).alias("line")).distinct()).select("id", "status", "similarity", "old_path", "path"),
            "SELECT DISTINCT id, upper(status) AS status, CASE WHEN upper(status) IN ('R', 'C') THEN 100 END::INT AS similarity, CASE WHEN upper(status) IN ('R', 'C') THEN 'old/' || path END AS old_path, path FROM files WHERE path IS NOT NULL AND status IS NOT NULL",
        ),
        "SRC-07": (lambda t: parsers.numstat(numstat_lines(t)).groupBy("path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed")), NUMSTAT + "SELECT path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM stat GROUP BY path"),
        "SRC-08": (stat_history, NUMSTAT + "SELECT sha, CAST(sum(added) AS BIGINT) AS additions, CAST(sum(removed) AS BIGINT) AS deletions, count(*) AS files FROM stat GROUP BY sha"),
        "SRC-09": (
            blame,
            "SELECT path, CAST(lines AS BIGINT) AS line_no, sha, author FROM change JOIN commit USING (sha) QUALIFY row_number() OVER (PARTITION BY path, CAST(lines AS BIGINT) ORDER BY date DESC, sha DESC) = 1",
        ),
        "SRC-10": (
            workspace,
            """, l AS (SELECT path, upper(status[1]) AS letter, load_batch = max(load_batch) OVER (PARTITION BY path) AS now FROM files WHERE path IS NOT NULL AND status IS NOT NULL),
            s AS (SELECT path, max(CASE WHEN NOT now THEN letter END) AS x, max(CASE WHEN now THEN letter END) AS y FROM l GROUP BY path)
            SELECT path, x AS status, 'staged' AS part FROM s WHERE x IS NOT NULL UNION ALL SELECT path, y, 'unstaged' FROM s WHERE y IS NOT NULL""",
        ),
        "SRC-11": (
            blobs,
            ", k AS (SELECT doc_id, sha1(text) AS blob, strlen(text) AS size FROM documents WHERE text IS NOT NULL) SELECT doc_id, blob, min(size) OVER (PARTITION BY blob) AS size, count(*) OVER (PARTITION BY blob) AS documents FROM k",
        ),
        "SRC-12": (
            lambda t: t.files.select(F.lower(F.btrim("sha")).alias("sha")).where("sha IS NOT NULL").distinct().join(t.commits_metadata.select(F.lower(F.btrim("sha")).alias("sha")), "sha", "left_anti"),
            "SELECT DISTINCT lower(trim(sha)) AS sha FROM files WHERE sha IS NOT NULL AND lower(trim(sha)) NOT IN (SELECT lower(trim(sha)) FROM commits_metadata WHERE sha IS NOT NULL)",
        ),
        "SRC-13": (
            lambda t: t.symbols.select("id", "path", "name", "kind", "signature").distinct(),
            "SELECT DISTINCT id, path, name, kind, signature FROM symbols",
        ),
        "SRC-14": (
            lambda t: parsers.declarations(t.documents, "doc_id"),
            ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL), f AS ("
            + " UNION ALL ".join(f"SELECT doc_id, line_no, '{kind}' AS kind, length(regexp_extract(line, '{pattern}', 1)) AS mark, trim(regexp_extract(line, '{pattern}', 2)) AS name FROM l" for kind, pattern in parsers.DECLARES.items())
            + ") SELECT doc_id, line_no, kind, CASE kind WHEN 'heading' THEN mark ELSE mark // 2 END AS level, name FROM f WHERE name <> ''",
        ),
        "SRC-15": (
            lambda t: parsers.import_edges(parsers.lines(t.documents, "doc_id"), "doc_id"),
            r""", l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL),
            f AS (SELECT doc_id, line_no, 'import' AS form, regexp_extract(line, 'import\s+.*?\s+from\s+[''"]([^''"]+)[''"]', 1) AS import_path FROM l
            UNION ALL SELECT doc_id, line_no, 'require', regexp_extract(line, 'require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1) FROM l
            UNION ALL SELECT doc_id, line_no, 'use', regexp_extract(line, '^use\s+([^;]+);', 1) FROM l
            UNION ALL SELECT doc_id, line_no, 'include', regexp_extract(line, '(?:require_once|include|include_once)\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1) FROM l)
            SELECT * FROM f WHERE import_path <> ''""",
        ),
        "SRC-16": (
            lambda t: parsers.dependency_edges(t.documents.where(_CODE), "doc_id"),
            rf""", d AS (SELECT doc_id, text FROM documents WHERE {_CODE}), c AS (SELECT doc_id, 'calls' AS edge_type, unnest(regexp_extract_all(text, '(\w+)\s*\(', 1)) AS target FROM d), u AS (SELECT doc_id, 'uses' AS edge_type, unnest(regexp_extract_all(text, '\b(?:{"|".join(parsers.USES)})\s+([A-Za-z_]\w*)', 1)) AS target FROM d),
            l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM d), i AS ({" UNION ALL ".join("SELECT doc_id, 'imports' AS edge_type, regexp_extract(line, '" + p.replace("'", "''") + "', 1) AS target FROM l" for p in parsers.IMPORT_FORMS.values())})
            SELECT doc_id, edge_type, target, count(*) AS n FROM (SELECT * FROM c WHERE target NOT IN ({', '.join(repr(x) for x in parsers.NO_CALLS)}) UNION ALL SELECT * FROM u UNION ALL SELECT * FROM i WHERE target <> '') GROUP BY ALL""",
        ),
        "SRC-17": (
            gated,
            rf""", d AS (SELECT doc_id, {_NORM.format('file_path')} AS p, strlen(text) AS size FROM documents WHERE file_path IS NOT NULL), g AS (SELECT DISTINCT {_NORM.format('path')} AS p FROM files WHERE upper(status) = 'D' AND path IS NOT NULL)
            SELECT doc_id, p AS path FROM d WHERE p NOT IN (SELECT p FROM g) AND size <= {parsers.MAX_BYTES} AND trim(p) <> '' AND NOT ({' OR '.join(f"starts_with(p, '{x}') OR contains(p, '/{x}')" for x in parsers.EXCLUDED)})
            AND lower(regexp_extract(regexp_extract(p, '[^/]*$'), '.\.([^.]+)$', 1)) IN ({', '.join(repr(x) for x in parsers.EXTENSIONS)})""",
        ),
        "SRC-18": (lambda t: t.documents.where(F.octet_length("text") <= parsers.MAX_BYTES).select("doc_id"), f"SELECT doc_id FROM documents WHERE strlen(text) <= {parsers.MAX_BYTES}"),
        "SNK-01": (
            lambda t: upserts.upsert(t.symbol_versions.select(F.lower(F.btrim("sha")).alias("sha"), F.lower("dna_id").alias("dna_id"), "id", "name"), ["sha", "dna_id"], "id"),
            "SELECT lower(trim(sha)) AS sha, lower(dna_id) AS dna_id, id, name FROM symbol_versions QUALIFY row_number() OVER (PARTITION BY lower(trim(sha)), lower(dna_id) ORDER BY id DESC, name) = 1",
        ),
        "SNK-02": (
            first_seen,
            "SELECT dna_id, id, sha FROM (SELECT lower(dna_id) AS dna_id, id, sha FROM symbol_versions WHERE load_batch > 30) WHERE dna_id NOT IN (SELECT lower(dna_id) FROM symbol_versions WHERE load_batch <= 30) QUALIFY row_number() OVER (PARTITION BY dna_id ORDER BY id, sha) = 1",
        ),
        "SNK-03": (appended, "SELECT id, name FROM symbol_history WHERE change_type IN ('added', 'removed')"),
        "SNK-04": (
            lambda t: upserts.set_flag(t.commit.join(t.commit.groupBy("status").agg(F.max(F.struct("date", "sha")).alias("h")), "status"), "status", F.col("sha") == F.col("h.sha"), "is_head").select("sha", "status", "is_head"),
            "SELECT sha, status, row_number() OVER (PARTITION BY status ORDER BY date DESC, sha DESC) = 1 AS is_head FROM commit",
        ),
        "SNK-05": (
            lambda t: t.commit.where(F.col("date") >= F.lit("1995-01-01").cast("timestamp")).join(t.change.where("change_type = 'removed'").select("sha"), "sha", "left_anti").select("sha"),
            "SELECT sha FROM commit WHERE date >= TIMESTAMP '1995-01-01' AND sha NOT IN (SELECT sha FROM change WHERE change_type = 'removed')",
        ),
        "SNK-06": (
            facts_file,
            """SELECT sha, '{"author":' || author || ',"message":"' || message || '","sha":' || sha || '}' AS fact FROM commit""",
        ),
        "SNK-07": (
            markdown,
            """, f AS (SELECT path, count(*) AS n FROM change GROUP BY path ORDER BY n DESC, path LIMIT 10), l AS (SELECT 1 AS s, 0 AS r, '# Change report' AS line UNION ALL SELECT 2, 0, 'Commits: ' || count(*) FROM commit UNION ALL SELECT 3, 0, 'Changed symbols: ' || count(*) FROM change UNION ALL SELECT 4, 0, '## Largest commits'
            UNION ALL SELECT 5, row_number() OVER (ORDER BY size DESC, sha), '- **' || sha || '** by ' || author || ': ' || message FROM (SELECT * FROM commit ORDER BY size DESC, sha LIMIT 10) UNION ALL SELECT 6, 0, '## Most changed files' UNION ALL SELECT 7, row_number() OVER (ORDER BY n DESC, path), '- ' || path || ': ' || n || ' changes' FROM f)
            SELECT row_number() OVER (ORDER BY s, r) - 1 AS n, line FROM l""",
        ),
        "SNK-08": (
            mermaid,
            "SELECT 'graph LR' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS graph FROM (SELECT '  n' || src || ' -->|' || edge_type || '| n' || dst AS line FROM (SELECT * FROM edge WHERE confidence > 0.5 ORDER BY confidence DESC, src, dst, edge_type LIMIT 40))",
        ),
        "SNK-09": (
            lambda t: upserts.upsert(t.embeddings.where("label < 5").select("vec_id", F.lit(1).alias("seq"), "label").unionByName(t.embeddings.where("label > 2").select("vec_id", F.lit(2).alias("seq"), (F.col("label") + 100).alias("label"))), ["vec_id"], "seq"),
            "SELECT vec_id, CASE WHEN label > 2 THEN 2 ELSE 1 END AS seq, CASE WHEN label > 2 THEN label + 100 ELSE label END AS label FROM embeddings",
        ),
    }
)
