"""Fingerprints, normal forms of code text, and derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UINT32 = 4294967296


def digest(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def normal_body(text: Column) -> Column:
    """Code without block and line comments, white space collapsed, trimmed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"/\*[\s\S]*?\*/", ""), r"//[^\n]*", "")
    return F.trim(F.regexp_replace(plain, r"[ \t\n\r\f\x0b]+", " "))


def body_hash(text: Column, length: int = 16) -> Column:
    return digest(normal_body(text), length)


def shape(text: Column) -> Column:
    """Code with identifiers, numbers and quoted texts replaced one after the other, white space dropped."""
    ids = F.regexp_replace(text, r"[a-zA-Z_$][a-zA-Z0-9_$]*", "ID")
    numbers = F.regexp_replace(ids, r"[0-9]+", "NUM")
    texts = F.regexp_replace(numbers, r"""(["'`])[^"'`]*["'`]""", "STR")
    return F.regexp_replace(texts, r"[ \t\n\r\f\x0b]+", "")


def shape_hash(text: Column, length: int = 8) -> Column:
    return digest(shape(text), length)


def normal_signature(signature: Column) -> Column:
    """Signature without parameter names and white space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(signature, r"[A-Za-z0-9_]+\s*:", ":"), r"[ \t\n\r\f\x0b]+", ""))


def ngrams(sequence: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Sorted distinct n-grams of an array of texts, joined by commas."""

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(sequence) - (n - 1), F.lit(1)))
        return F.when(F.size(sequence) >= n, F.transform(starts, lambda i: F.array_join(F.slice(sequence, i, n), ","))).otherwise(F.array().cast("array<string>"))

    made = [grams(n) for n in sizes]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*made))))


def ngram_fingerprint(sequence: Column) -> Column:
    """First 12 hex digits of the hash of ``gram:1`` joined by ``|``."""
    return digest(F.array_join(F.transform(ngrams(sequence), lambda g: F.concat(g, F.lit(":1"))), "|"), 12)


def symbol_dna(kind: Column, signature: Column, *more: Column) -> Column:
    """Structural identity of a symbol: 16 hex digits of kind, normal signature and further parts."""
    return digest(F.concat_ws("::", kind, normal_signature(signature), *more), 16)


def set_hash(items: Column, length: int = 16) -> Column:
    """Hash of a collection whatever its order: sorted, joined by ``|``."""
    return digest(F.array_join(F.array_sort(items), "|"), length)


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object sorted and no white space; the entries of an array at the top are sorted too, further in their order counts.

    Null where the text is no JSON.
    """
    whole = F.try_parse_json(text)
    entries = F.transform(F.try_variant_get(whole, "$", "array<variant>"), lambda x: F.to_json(x))
    return F.when(F.schema_of_variant(whole).startswith("ARRAY"), F.concat(F.lit("["), F.array_join(F.array_sort(entries), ","), F.lit("]"))).otherwise(F.to_json(whole))


def rolling_hash(text: Column) -> Column:
    """31-multiplier hash of a text as unsigned 32-bit number, 0 replaced by 1; an empty text gives 1."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(_UINT32)))
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


def signed32(h: Column) -> Column:
    return F.when(h >= _UINT32 // 2, h - _UINT32).otherwise(h)


def hash_embedding(text: Column, size: int) -> Column:
    """A vector made of a text's hash: sin((h + i) / 100) / 2 + 1/2."""
    h = signed32(rolling_hash(text))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.sin((h + i) * F.lit(0.01)) * 0.5 + 0.5)


def callee_name(raw: Column) -> Column:
    """Bare name of a callee: prefix of the kind dropped, last part after ``:``, ``.`` or space, word characters only."""
    last = F.element_at(F.split(F.regexp_replace(raw, "^(?:function|method)_", ""), r"[:.\s]"), -1)
    return F.regexp_replace(last, r"[^A-Za-z0-9_]", "")


def edge_dna(endpoint: Column) -> Column:
    """Identity at an edge's end: what follows the last colon; an unknown end has none."""
    return F.when(~endpoint.startswith("unknown:"), F.substring_index(endpoint, ":", -1))


def edge_parts(text: Column) -> Column:
    """``from -> to (type)`` as a struct."""
    pattern = r"^(.*?) -> (.*) \((\w+)\)$"
    return F.struct(*(F.regexp_extract(text, pattern, i + 1).alias(n) for i, n in enumerate(("src", "dst", "edge_type"))))


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1, both included) of a text."""
    lines = F.split(text, "\n", -1)
    begin = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(lines, begin, F.greatest(F.least(last, F.size(lines)) - begin + 1, F.lit(0))), "\n")


def token_estimate(text: Column) -> Column:
    """Tokens of a text by its length: 3.5 characters each where over a tenth are code characters, else 4."""
    code = F.length(text) - F.length(F.translate(text, "{}[]();=<>", ""))
    return F.ceil(F.length(text) / F.when(code / F.greatest(F.length(text), F.lit(1)) > 0.1, 3.5).otherwise(4.0))


def version_key(version: Column) -> Column:
    """Sortable form of a dotted version: numbers padded with zeros to four parts."""
    numbers = F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), 4)), 1, 4)
