"""Text logs and source texts as rows: parsing by Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Path prefixes that are never processed, extensions that are, and the size limit in bytes.
EXCLUDED = ["node_modules/", ".git/", "dist/", "out/", "build/", "public/", "vendor/", "storage/"]
EXTENSIONS = ["ts", "tsx", "js", "jsx", "php", "py", "go", "rs", "css", "md", "json", "yaml", "yml", "html", "vue"]
MAX_BYTES = 1_048_576

# Words before a parenthesis that are no calls.
NO_CALLS = ["if", "while", "for", "foreach", "switch", "catch", "return", "function", "echo", "print", "isset", "empty", "typeof", "await", "new", "def", "func"]


def lines(texts: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row per line: the kept columns, line_no from 1, line.  Null texts have none, an empty text has one empty line."""
    return texts.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("_i", "line")).select(*keep, (F.col("_i") + 1).cast("long").alias("line_no"), "line")


def numstat(rows: DataFrame, line: str = "line") -> DataFrame:
    """``added<TAB>removed<TAB>path`` lines as columns; a count of ``-`` (binary) is null."""
    part = F.split(line, "\t", 3)
    return rows.where(F.size(part) == 3).select(
        "*", F.try_element_at(part, F.lit(1)).try_cast("long").alias("added"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("removed"), F.try_element_at(part, F.lit(3)).alias("path")
    )


def log_records(records: DataFrame, mark: str, record: str = "value") -> DataFrame:
    """Records of a commit log as columns sha, author, date, message, parent; a record of fewer fields has empty ones, an empty record none."""
    part = F.split(record, mark, -1)
    names = ["sha", "author", "date", "message", "parent"]
    return records.where(F.col(record).isNotNull() & (F.col(record) != "")).select(*(F.coalesce(F.get(part, i), F.lit("")).alias(n) for i, n in enumerate(names)))


def name_status(rows: DataFrame, line: str = "line") -> DataFrame:
    """``status<TAB>path`` lines as columns; renames and copies carry a similarity and the old path before the new one."""
    part = F.split(line, "\t", 3)
    pair = part[0].rlike("^[RC]")
    return rows.select("*", F.substring(part[0], 1, 1).alias("status"), F.when(pair, F.substring(part[0], 2, 3).try_cast("int")).alias("similarity"), F.when(pair, F.get(part, 1)).alias("old_path"), F.when(pair, F.get(part, 2)).otherwise(F.get(part, 1)).alias("path"))


def status_lines(rows: DataFrame, line: str = "line") -> DataFrame:
    """``XY path`` lines as (path, status, part): X is the staged state, Y the unstaged one, a blank is none."""
    states = F.array(F.struct(F.substring(line, 1, 1).alias("status"), F.lit("staged").alias("part")), F.struct(F.substring(line, 2, 1).alias("status"), F.lit("unstaged").alias("part")))
    return rows.select(F.expr(f"substring({line}, 4)").alias("path"), F.explode(F.filter(states, lambda s: s["status"] != " ")).alias("s")).select("path", "s.status", "s.part")


def fill_header(rows: DataFrame, is_header: Column, value: Column, group: str, order: str, name: str) -> DataFrame:
    """Each row with the value of the last header row at or above it in its group."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(is_header, value), ignorenulls=True).over(w))


def _called(words: list[str]) -> str:
    return rf"(?:{'|'.join(words)})\s*\(\s*{_QUOTED}\s*\)"


_QUOTED = r"""['"]([^'"]+)['"]"""
#: How a line names what it imports, by form; the first group is the path.
IMPORT_FORMS = {"import": rf"import\s+.*?\s+from\s+{_QUOTED}", "require": _called(["require"]), "use": r"^use\s+([^;]+);", "include": _called(["require_once", "include", "include_once"])}


def import_edges(numbered: DataFrame, key: str) -> DataFrame:
    """Imports of numbered lines: key, line_no, import_path, form (import, require, use, include)."""
    text = F.btrim("line")
    found = F.array(*(F.struct(F.lit(form).alias("form"), F.regexp_extract(text, pattern, 1).alias("import_path")) for form, pattern in IMPORT_FORMS.items()))
    return numbered.select(key, "line_no", F.explode(F.filter(found, lambda x: x["import_path"] != "")).alias("x")).select(key, "line_no", "x.import_path", "x.form")


def call_edges(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, callee, calls): words before an opening parenthesis that are no language words."""
    words = F.regexp_extract_all(text, F.lit(r"(\w+)\s*\("), F.lit(1))
    return texts.select(key, F.explode(words).alias("callee")).where(~F.col("callee").isin(NO_CALLS)).groupBy(key, "callee").agg(F.count(F.lit(1)).alias("calls"))


#: What a line declares in a structured text, by kind: a pattern for its indent or marks, and its name.
DECLARES = {"heading": r"^(#{1,6})\s+(\S[^\r]*)\r?$", "yaml_key": r"^((?:  )*)(?:- )?([A-Za-z_][A-Za-z0-9_-]*):(?: |\r?$)", "json_key": r'^( *)"([^"]+)"\s*:', "css_rule": r"^( *)([.#]?[A-Za-z][A-Za-z0-9_ .#>:-]*?)\s*\{\r?$"}


def declarations(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Structural facts of Markdown, YAML, JSON and CSS lines: key, line_no, kind, level (marks, or indent by two), name."""
    line = F.col("line")
    found = F.array(*(F.struct(F.lit(kind).alias("kind"), F.length(F.regexp_extract(line, pattern, 1)).alias("mark"), F.btrim(F.regexp_extract(line, pattern, 2)).alias("name")) for kind, pattern in DECLARES.items()))
    each = lines(texts, key, text=text).select(key, "line_no", F.explode(F.filter(found, lambda x: x["name"] != "")).alias("x"))
    return each.select(key, "line_no", "x.kind", F.when(F.col("x.kind") == "heading", F.col("x.mark")).otherwise(F.floor(F.col("x.mark") / 2)).cast("long").alias("level"), "x.name")


#: Words before the name of a type that is used.
USES = ["new", "extends", "implements", "instanceof"]


def dependency_edges(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, edge_type, target, n): imports, calls and uses of types."""
    imports = import_edges(lines(texts, key, text=text), key).select(key, F.lit("imports").alias("edge_type"), F.col("import_path").alias("target"))
    uses = texts.select(key, F.lit("uses").alias("edge_type"), F.explode(F.regexp_extract_all(text, F.lit(rf"\b(?:{'|'.join(USES)})\s+([A-Za-z_]\w*)"), F.lit(1))).alias("target"))
    calls = call_edges(texts, key, text).select(key, F.lit("calls").alias("edge_type"), F.col("callee").alias("target"), F.col("calls").alias("n"))
    return imports.unionByName(uses).groupBy(key, "edge_type", "target").agg(F.count(F.lit(1)).alias("n")).unionByName(calls)


def processable(path: Column, size: Column | None = None) -> Column:
    """Whether a path passes the source gate: not blank, no excluded prefix, a known extension, not too large.  A null size fails."""
    slashed = F.translate(path, "\\", "/")
    excluded = F.lit(False)
    for prefix in EXCLUDED:
        excluded = excluded | slashed.startswith(prefix) | slashed.contains("/" + prefix)
    name = F.element_at(F.split(slashed, "/"), -1)
    extension = F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1))
    good = path.isNotNull() & (F.btrim(path) != "") & ~excluded & extension.isin(EXTENSIONS)
    return good if size is None else good & F.coalesce(size <= MAX_BYTES, F.lit(False))
