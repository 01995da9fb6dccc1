"""Naming conventions of symbols, files and imports, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.parsers import EXTENSIONS

# Conventions in declared order (a tie goes to the earlier).
CONVENTIONS = ["camelCase", "PascalCase", "snake_case", "SCREAMING_SNAKE", "kebab-case", "hungarian", "mixed"]
# Import styles in declared order.
IMPORT_STYLES = ["absolute", "relative", "alias", "package", "index", "extension", "no-extension"]


def convention(name: Column) -> Column:
    """Convention of a name; null and empty are unknown."""
    under, upper, dash = name.contains("_"), name.rlike("[A-Z]"), name.contains("-")
    return (
        F.when(name.isNull() | (name == ""), "unknown")
        .when(name.rlike("^[a-z][^_A-Z-]*$"), "camelCase")
        .when(under & (name == F.upper(name)), "SCREAMING_SNAKE")
        .when(under & ~upper, "snake_case")
        .when(dash & ~upper, "kebab-case")
        .when(under & upper, "mixed")
        .when(name.rlike("^[A-Z]"), "PascalCase")
        .when(name.rlike("^[a-z]") & upper, "camelCase")
        .otherwise("unknown")
    )


def confidence(name: Column) -> Column:
    """How sure the convention of a name is."""
    style = convention(name)
    return F.when(name.isNull() | (name == ""), 0.0).when((style == "mixed") | name.rlike("^[a-z][^_A-Z-]*$"), 0.7).when(style == "unknown", 0.5).otherwise(0.9)


def parts(name: Column) -> Column:
    """The words of a name, lower case, split at separators and before capitals; all-capital names only at separators."""
    spaced = F.when(name == F.upper(name), name).otherwise(F.regexp_replace(name, "([A-Z])", "_$1"))
    return F.filter(F.split(F.lower(spaced), "[_-]"), lambda x: x != "")


def renamed(name: Column, target: str) -> Column:
    """The name in another convention; a name without words stays."""
    words = parts(name)
    head, capitals = F.try_element_at(words, F.lit(1)), F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    tail = F.array_join(F.slice(capitals, 2, 1000), "")
    made = {
        "camelCase": F.concat(head, tail),
        "PascalCase": F.array_join(capitals, ""),
        "snake_case": F.array_join(words, "_"),
        "SCREAMING_SNAKE": F.upper(F.array_join(words, "_")),
        "kebab-case": F.array_join(words, "-"),
        "mixed": F.concat(head, F.lit("_"), tail),
    }[target]
    return F.when(F.size(words) > 0, made).otherwise(name)


def basename(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def dirname(path: Column) -> Column:
    """Directory of a path, '' at the top."""
    slashed = F.translate(path, "\\", "/")
    return F.regexp_extract(slashed, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without dot, '' if there is none; a leading dot begins no extension."""
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def file_style(path: Column) -> Column:
    """Naming style of a file; a plain lower-case name follows its directory's separator."""
    name, parent = stem(path), F.substring_index(dirname(path), "/", -1)
    under, upper, dash = name.contains("_"), name.rlike("[A-Z]"), name.contains("-")
    return (
        F.when(under & (name == F.upper(name)), "SCREAMING_SNAKE")
        .when(under & ~upper, "snake_case")
        .when(dash & ~upper, "kebab-case")
        .when(name.rlike("^[A-Z]"), "PascalCase")
        .when(upper, "camelCase")
        .when(parent.contains("_") & ~parent.contains("-"), "snake_case")
        .when(parent.contains("-") & ~parent.contains("_"), "kebab-case")
        .otherwise("camelCase")
    )


def import_style(path: Column) -> Column:
    """Style of an import path."""
    end = F.regexp_extract(F.substring_index(path, "/", -1), r".\.([^./]*)$", 1)
    local = path.startswith("./") | path.startswith("../")
    return (
        F.when(path.isNull() | ~path.rlike(r"[/\\]"), "package")
        .when(path.startswith("@/"), "alias")
        .when(path.startswith("@"), "package")
        .when(path.startswith("/"), "absolute")
        .when(local & path.rlike(r"/index(\.js|\.ts)?$"), "index")
        .when(local & (end != "") & ~end.isin(EXTENSIONS), "extension")
        .when(local, "no-extension")
        .otherwise("relative")
    )


def well_named(name: Column, kind: Column) -> Column:
    """Whether functions and methods start lower case and classes upper case; other kinds always pass."""
    return F.when(kind.isin("function", "method"), name.rlike("^[a-z][a-zA-Z0-9]*$")).when(kind == "class", name.rlike("^[A-Z][a-zA-Z0-9]*$")).otherwise(F.lit(True))


def parameters(signature: Column) -> Column:
    """Parameter names of a signature, in order."""
    inside = F.split(F.regexp_extract(signature, r"\(([^)]*)\)", 1), ",")
    return F.filter(F.transform(inside, lambda p: F.btrim(F.regexp_extract(F.btrim(p), "^[^:=]*", 0))), lambda p: p != "")


def return_convention(signature: Column) -> Column:
    """promise, async, callback, sync or unknown, by the signature's text."""
    return (
        F.when(signature.contains("Promise<") | signature.contains(": Promise"), "promise")
        .when(signature.contains("async"), "async")
        .when(signature.contains("callback") | signature.contains("cb") | signature.rlike(r"\(.*\)\s*=>"), "callback")
        .when(signature.rlike(r":\s*[A-Z][a-zA-Z0-9<>\[\]]+"), "sync")
        .otherwise("unknown")
    )
