"""Training-data operators against brute force and on edge cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import leakage, mixing, mojibake, topn


# top N


def test_top_n(spark, rows):
    nan, inf = float("nan"), float("inf")
    data = [("f", "a", 1.0), ("f", "a", 3.0), ("f", "b", 3.0), ("f", "c", -0.0), ("f", "d", 0.0), ("f", "e", nan), ("f", "g", inf), ("f", "h", None), (None, "a", 9.0), ("f", None, 9.0), ("g", "z", -5.0), ("g", "z", -5.0)]
    df = spark.createDataFrame([(*d, 1) for d in data], "grp string, item string, score double, rank_no int")
    got = rows(topn.top_n(topn.best_scores(df), 3), "grp", "rank_no", "item")
    assert got == [("f", 1, "a"), ("f", 2, "b"), ("f", 3, "c"), ("g", 1, "z")]
    assert topn.top_n(topn.best_scores(df.limit(0)), 3).count() == 0


def test_top_n_is_pruned_before_the_shuffle(spark):
    df = spark.createDataFrame([("f", "a", 1.0)], "grp string, item string, score double")
    plan = topn.top_n(topn.best_scores(df), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# leakage


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abc"), max_size=16))
def test_myers(pattern, text):
    want = min(edit(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert leakage.myers(pattern, text) == want


def test_words():
    assert leakage.words_of("A-b_cK é1x\n") == ["a", "b", "c", "1x"]
    assert leakage.words_of(None) == [] and leakage.words_of("\ud800ab") == ["ab"]


def test_leaks(spark, rows):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 30])))) for i in range(12)] + [(99, "x")]
    docs = []
    for d in range(60):
        noise = rng.choices(vocabulary, k=30)
        w = items[rng.randrange(12)][1].split()
        n = rng.randrange(8, 16)
        part = w[rng.randrange(max(1, len(w) - n)) :][:n]
        docs.append((d, ", ".join(noise[:10] + [x.upper() for x in part] + noise[10:])))
    docs += [(None, items[1][1]), (100, None), (101, ""), (102, items[1][1] + " é " * 50_000 + items[2][1]), (103, docs[0][1])]

    def grams(text):
        w = leakage.words_of(text)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = sorted((d, i) for d, t in docs for i, x in items if d is not None and grams(t) & grams(x))
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, distance int")
    q = spark.createDataFrame(items, "item_id long, item_text string")
    found = leakage.leaks(df, q)
    assert rows(found.where("distance = 0"), "doc_id", "item_id") == want and want
    assert leakage.leaks(df.limit(0), q).count() == 0 and leakage.leaks(df, q.limit(0)).count() == 0


def test_leaks_with_one_edit(spark, rows):
    item = " ".join(f"k{i}" for i in range(20))
    w = item.split()
    texts = [" ".join(w[3:9] + ["oops"] + w[10:15]), " ".join(w[3:9] + w[10:16]), " ".join(w[3:9] + ["and"] + w[9:15]), " ".join(w[3:7] + ["a", "b"] + w[9:15])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(leakage.leaks(df, spark.createDataFrame([(1, item)], "item_id long, item_text string"))) == [(0, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_leaks_of_many_items_in_a_small_table(spark, rows, monkeypatch):
    """A bit table too small for its pieces lets windows pass that the join then refuses."""
    items = spark.createDataFrame([(i, " ".join(f"{i}x{k}" for k in range(15))) for i in range(60)], "item_id long, item_text string")
    docs = items.withColumnsRenamed({"item_id": "doc_id", "item_text": "text"}).unionByName(spark.createDataFrame([(1000 + i, " ".join(f"y{i}z{k}" for k in range(200))) for i in range(20)], "doc_id long, text string"))
    monkeypatch.setattr(leakage, "MOST_BITS", 1 << 10)
    assert rows(leakage.leaks(docs, items), "doc_id", "item_id", "distance") == [(i, i, 0) for i in range(60)]


def test_distance_of_equal_hashes():
    item, doc = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(14)]
    assert leakage.distance(item, 0, doc, 1, 6, 12, 1) == 2 and leakage.distance(item, 6, item, 6, 6, 12, 1) == 0


# mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 40)), min_size=1, max_size=6), st.integers(0, 120))
def test_apportion(pairs, seats):
    weights, caps = [p[0] for p in pairs], [p[1] for p in pairs]
    want = [0] * len(pairs)
    for _ in range(seats):
        open_ = [i for i in range(len(pairs)) if want[i] < caps[i]]
        if not open_:
            break
        i = max(open_, key=lambda k: (weights[k] / (2 * want[k] + 1), -k))
        want[i] += 1
    got = mixing.apportion(weights, seats, caps)
    assert sum(got) == sum(want) and all(abs(a - b) <= 1 for a, b in zip(got, want))
    if len(set(weights)) == len(weights):
        assert got == want


def test_mix_reaches_shares(spark, rows):
    rng = random.Random(5)
    docs = [(i, "big" if i < 900 else "small" if i < 960 else "other", rng.randrange(20, 200)) for i in range(1000)] + [(2000, None, 50), (2001, "big", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = [("big", 0.6, 2), ("small", 0.35, 4), ("absent", 0.05, 3)]
    got = mixing.mix(df, targets).collect()
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} == {"big", "small"}
    assert all(1 <= r.copies <= {"big": 2, "small": 4}[r.source] for r in got)
    total = sum(r.tokens * r.copies for r in got)
    small = sum(r.tokens * r.copies for r in got if r.source == "small") / total
    assert abs(small - 0.35 / 0.95) < 0.02
    assert max(r.copies for r in got if r.source == "small") == 4
    assert rows(mixing.mix(df, targets)) == sorted(tuple(r) for r in got)  # the seed decides


def test_mix_with_larger_total(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 100) for i in range(200)], "doc_id long, source string, tokens long")
    got = mixing.mix(df, [("a", 0.9, 1), ("b", 0.1, 3)], total_tokens=30_000, block_tokens=100).collect()
    assert sum(r.tokens * r.copies for r in got if r.source == "a") == 10_000
    assert sum(r.tokens * r.copies for r in got if r.source == "b") == 20_000


@pytest.mark.parametrize("block, total", [(None, None), (400, 120_000)])
def test_mix_of_more_shards_than_blocks(spark, monkeypatch, block, total):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 20)
    assert 1 + 5000 // 20 > mixing.LEAST_BLOCKS
    df = spark.createDataFrame([(i, "a" if i < 5000 else "b", 10 + i % 7) for i in range(10_000)], "doc_id long, source string, tokens long")
    got = mixing.mix(df, [("a", 0.6, 1), ("b", 0.4, 2)], total, block).collect()
    there = sum(10 + i % 7 for i in range(5000))
    a, b = (sum(r.tokens * r.copies for r in got if r.source == s) for s in "ab")
    assert abs(a / (a + b) - 0.6) < 0.02 or total
    # the source with the least room is used up
    assert a > 0.97 * there and (not total or a + b > 0.97 * total)


def test_mix_in_segments_is_the_same(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 3}", 5 + i % 11) for i in range(3000)], "doc_id long, source string, tokens long")
    targets = [(f"s{k}", 0.2 + 0.1 * k, 2) for k in range(3)] + [(f"none{k}", 0.0001, 1) for k in range(1500)]
    monkeypatch.setattr(mixing, "MAX_SHARDS", 2)
    want = rows(mixing.mix(df, targets, 30_000, 50))
    monkeypatch.setattr(mixing, "SHARD_DOCS", 500)
    assert mixing.mix(df, targets, 30_000, 50).count() and want
    monkeypatch.setattr(mixing, "MAX_SHARDS", 1)
    one = rows(mixing.mix(df, targets, 30_000, 50))
    monkeypatch.setattr(mixing, "SHARD_DOCS", 20)  # some fifty segments a shard
    assert rows(mixing.mix(df, targets, 30_000, 50)) == one


def test_mix_edges(spark):
    clash = spark.createDataFrame([(1, "a", 50, 1, 2, 3), (None, "a", 9, 1, 2, 3), (3, "a", None, 1, 2, 3)], "doc_id long, source string, tokens long, budget int, shard int, copies int")
    assert {r.doc_id: r.copies for r in mixing.mix(clash, [("a", 1.0, 1)]).collect()} == {1: 1, 3: 1}
    df = spark.createDataFrame([(1, "a", 0)], "doc_id long, source string, tokens long")
    assert mixing.mix(df, []).count() == 0 and mixing.mix(df, [("a", 1.0, 1)]).count() == 0 and mixing.mix(df, [("a", 0.0, 1), ("b", 1.0, 0)]).count() == 0
    assert mixing.mix(df.limit(0), [("a", 1.0, 1)]).count() == 0


def test_tokens(spark, rows):
    df = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None), (3, "a", ""), (4, "a", "<|endoftext|>"), (5, "a", "é漢字 " * 20_000)], "doc_id long, source string, text string")
    got = {r.doc_id: r.tokens for r in mixing.count_tokens(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 20_000


# garbled text

SENTENCES = ["Die Größe des Puffers hängt von {} ab", "Le résumé généré diffère dès que {} échoue", "A função {} não é chamada após a sessão", "Después de la migración, {} perdió 2 señales", "Künftig läuft {} über ältere Zweige", "It’s the “{}” path — not the cache"]
RUSSIAN = ["Ошибка исчезает, когда кэш отключён", "Порядок версий больше не зависит от слияния веток", "Перед запуском нужно очистить старых записей"]


READ_AS = ["cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850"]


def reading(encoding):
    """Byte -> character; bytes that the encoding leaves undefined are read as the control of that number."""
    if encoding == "own":  # an encoding that no list has: letters of three scripts in an order of our own
        return {128 + i: chr(0x531 + i) if i < 38 else chr(0x10D0 + i - 38) if i < 71 else chr(0x3B1 + i - 71) if i < 88 else chr(0x5D0 + (i - 88) % 27) if i < 115 else chr(0x1200 + i) for i in range(128)}
    return {b: bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(128, 256)}


def read_as(text, encoding):
    back = reading(encoding)
    return "".join(chr(b) if b < 128 else back[b] for b in text.encode())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs, bad, whole = [], {}, {}

    def text():
        parts = [rng.choice(SENTENCES).format(rng.choice(["alpha", "beta", "gamma"])) for _ in range(4)]
        return "\n".join(parts + rng.sample(RUSSIAN, 2))

    for i in range(400):
        docs.append((i, text()))
    decoys = ["NÃO, SÃO, AÇÃO and PÃO", "Header row ÂGE / CÔTÉ", "src\n├── a\n│   └── b", "Vowel table: Â â Ã ã Å å", "the word “AMANHÔ is odd", "plain", "", None]
    docs += [(500 + i, d) for i, d in enumerate(decoys)]
    for i, encoding in enumerate(READ_AS * 4):
        clean = "\n".join(rng.sample(SENTENCES, 4)).format(*["alpha"] * 4)
        whole[1000 + i] = clean
        bad[1000 + i] = read_as(clean, encoding)
    clean = "\n".join(SENTENCES).format(*["beta"] * 6)
    whole[2000], bad[2000] = clean, read_as(read_as(clean, "cp1252"), "cp1252")
    for i in range(3):
        whole[2001 + i] = "\n".join(RUSSIAN)
        bad[2001 + i] = "\n".join(RUSSIAN).encode("koi8_r").decode("cp1251")
    for i in range(4):
        bad[2010 + i] = SENTENCES[i].format("gamma").encode("cp1252").decode("utf-8", "replace")
    return docs + list(bad.items()), set(bad), whole


def test_garbled(spark, corpus):
    docs, bad, whole = corpus
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, filling int")
    got = {r.doc_id: r for r in mojibake.garbled_documents(df).collect()}
    assert set(got) == bad
    right = [d for d in whole if got[d].restored == whole[d]]
    assert len(right) >= 0.9 * len(whole)


def test_garbled_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "é" * 100_000), (None, "Ã©")], "doc_id long, text string")
    assert mojibake.garbled_documents(df).count() == 0
    assert mojibake.garbled_documents(df.limit(0)).count() == 0


def test_an_encoding_of_no_list_is_learned(spark, corpus):
    docs, bad, _ = corpus
    rng = random.Random(4)
    clean = {5000 + i: "\n".join(rng.sample(SENTENCES[:5], 4)).format(*["alpha"] * 4) for i in range(20)}
    rows = [d for d in docs if d[0] not in bad] + [(i, read_as(t, "own")) for i, t in clean.items()]
    got = {r.doc_id: r.restored for r in mojibake.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = [i for i in clean if got.get(i) == clean[i]]
    print(f"own encoding: recall {len(set(got) & set(clean)) / len(clean):.2f}, precision {len(set(got) & set(clean)) / max(1, len(got)):.2f}, restored {len(right) / len(clean):.2f}")
    assert set(got) == set(clean) and len(right) >= 0.9 * len(clean)


def test_align():
    assert mojibake.align("Ã¼\x01Ã¤", "ü\x01ä") == (True, {("Ã¼", "ü"), ("Ã¤", "ä"), ("Ã¼Ã¤", "üä")})
    assert mojibake.align("ЛЬЫ", "кэш") == (False, {("ЛЬ", "кэ"), ("ЬЫ", "эш")})
    assert mojibake.align("Ã¼Ã", "ü") is None and mojibake.align("ab\x01c", "ab") is None and mojibake.align("ЛЛ", "кэ") is None
    assert mojibake.align("éé", "éé") is None


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aé漢ß€ñ"), st.sampled_from([*READ_AS, "own"]))
def test_undo_is_the_round_trip(text, encoding):
    mapping = mojibake.Mapping({c: b for b, c in reading(encoding).items()}, {})
    assert mapping.undo(read_as(text, encoding)) == text
