"""Decontamination, packing, the n-gram join and the pipeline against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import decontaminate, graph, langid, near_join, packing
from tidemark.llm.common import words_of
from tidemark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def plain_words(text: str | None) -> list[str]:
    import re

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(upper, upper.lower())))


def test_words():
    for t in ("A b-C_d1 É Ünï x y Ǆ İ 日本", "", None, "\x00a\x7fb`c", "ſK"):
        assert [w.decode() for w in words_of(t.encode() if t is not None else None)] == plain_words(t)


def plain_hits(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    out = []
    for i, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for k, t in items:
            v = plain_words(t)
            if k is None or not v:
                continue
            n = min(window, len(v))
            for a in range(len(v) - n + 1):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contaminated() -> tuple[list[tuple], list[tuple]]:
    rnd = random.Random(1)
    items = [(i, prose(rnd, rnd.randint(11, 40))) for i in range(20)] + [(20, "Only five words IN here"), (21, ""), (22, None), (None, "w1 w2 w3"), (3, "another text of item three which is long enough to count")]
    docs = [(i, prose(rnd, rnd.randint(0, 120))) for i in range(150)]
    for i in range(60):
        k, t = rnd.choice(items[:21])
        part = t.split()
        a = rnd.randint(0, max(0, len(part) - 12))
        piece = ", ".join(part[a : a + rnd.randint(5, 30)]).upper()
        docs.append((200 + i, f"{prose(rnd, rnd.randint(0, 20))} {piece} {piece} {prose(rnd, 5)}"))
    docs += [(900, None), (901, ""), (902, "..."), (903, prose(rnd, 30_000) + " " + items[0][1]), (200, docs[160][1]), (None, items[1][1]), (904, "w7 " * 300)]
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 60])
def test_decontamination(spark, monkeypatch, block):  # noqa: ANN001
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = contaminated()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = decontaminate.digest(decontaminate.matches(df, bench))
    assert sorted(map(tuple, got.collect()), key=str) == plain_hits(docs, items)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted([d for d in docs if not plain_hits([d], items)[0][5]], key=str)
    assert decontaminate.matches(df.limit(0), bench).collect() == []
    assert decontaminate.matches(df, bench.limit(0)).where("n_hit > 0").collect() == []


def test_spans_and_proximity(spark):  # noqa: ANN001
    phrase = [f"p{i}" for i in range(10)]
    docs = [(1, "x " + " ".join(phrase) + " y"), (2, " ".join([*phrase[:5], "extra", *phrase[5:]])), (3, " ".join([*phrase[:5], *["extra"] * 9, *phrase[5:]]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(phrase))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.matches(df, bench, slop=1).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(1, 11)]
    assert (got[1]["items"], got[2]["items"], got[3]["items"]) == (["7"], [], [])
    assert (got[1]["near_items"], got[2]["near_items"], got[3]["near_items"]) == (["7"], ["7"], [])
    found = {(r["term"], r["doc_id"]): r["positions"] for r in decontaminate.postings(decontaminate.build_index(df)).collect()}
    assert found["extra", 3] == list(range(5, 14)) and found["p0", 1] == [1]


def plain_near(docs: list[tuple], items: list[tuple], slop: int, window: int = 10) -> list[tuple]:
    out = []
    for i, text in docs:
        w = plain_words(text)
        found = set()
        for k, t in items:
            v = plain_words(t)
            if k is None or not v:
                continue
            n = min(window, len(v))
            for a in range(len(v) - n + 1):
                for s in range(-slop, len(w) + slop):
                    if all(v[a + j] in w[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j in range(n)):
                        found.add(str(k))
                        break
        out.append((i, sorted(found)))
    return sorted(out, key=str)


def test_proximity_does_not_depend_on_shards(spark):  # noqa: ANN001
    rnd = random.Random(11)
    items = [(i, " ".join(rnd.choice(VOCABULARY[:40]) for _ in range(rnd.randint(4, 14)))) for i in range(8)]
    docs = []
    for i in range(120):
        part = rnd.choice(items)[1].split()
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(part))
            if rnd.random() < 0.5:
                part.insert(at, rnd.choice(VOCABULARY))
            else:
                part[at : at + 2] = reversed(part[at : at + 2])
        docs.append((i, " ".join([rnd.choice(VOCABULARY[:40]) for _ in range(i % 3)] + part + ["the"] * (i % 2))))
    docs += [(200 + i, t) for i, t in enumerate(x for _, t in items for x in (" ".join(t.split()[:-2]), " ".join(t.split()[-2:]), " ".join(t.split()[1:])))]  # neighbours in a shard must not add up
    bench = spark.createDataFrame(items, "item_id long, text string")
    for parts in (1, 7):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        got = sorted(((r["doc_id"], r["near_items"]) for r in decontaminate.matches(df, bench, slop=2).collect()), key=str)
        assert got == plain_near(docs, items, 2)
    assert sum(bool(x) for _, x in got) > 10


TEXTS = ["", "plain words here", "Ünï 日本語 🙂 ‹›", "  spaces\t\n\n tabs", "it's we'll 12345 ###", "<|endoftext|> inside", "a" * 3000, " 　x", "ſtraße ǅ ١٢٣"]


def test_encoder_matches_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    assert own.fast is not None
    rnd = random.Random(2)
    texts = TEXTS + ["".join(chr(rnd.choice([rnd.randint(1, 0x250), rnd.randint(1, 0xD7FF), rnd.randint(0xE000, 0x2FFFF)])) for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert own(t) == library.encode(t, add_special_tokens=False).ids
    other = packing.Encoder(tokenizer_path("word_bpe_49k.json"))
    assert other.fast is None and other("Some Words") == Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode("Some Words", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" * 2_000_000, "\n" * 2_000_000, "x " + " \t" * 1_500 + "\u00a0" * 1_000 + "y", "日" * 5_000 + "  z"])
def test_encoder_on_long_runs(text):  # noqa: ANN001
    from tokenizers import Tokenizer

    assert packing.Encoder(tokenizer_path())(text) == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_ids_are_ranks_only_in_order_of_the_rules(tmp_path):  # noqa: ANN001
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.ranked_by_id(tokenizer_path())
    swapped = json.loads(json.dumps(spec))
    merges = swapped["model"]["merges"]
    merges[0], merges[40] = merges[40], merges[0]
    blanks = json.loads(json.dumps(spec))
    blanks["normalizer"] = {"type": "Lowercase"}
    for name, other in (("swapped.json", swapped), ("lower.json", blanks)):
        (tmp_path / name).write_text(json.dumps(other), encoding="utf-8")
        path = str(tmp_path / name)
        assert not packing.ranked_by_id(path)
        assert packing.Encoder(path)("The Rules apply") == packing.Encoder(path, False)("The Rules apply")


def check_packing(rows: list[dict], docs: list[tuple], capacity: int) -> int:
    """Every id in one piece, right checksums, gapless sequences; returns the padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    left = Counter()
    for i, text in docs:
        left[i, tuple([*t.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, pieces in by_doc.items():
        wanted = [(ids, n) for (d, ids), n in left.items() if d == i]
        spans = Counter((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces)
        cover = Counter()
        for (start, length, crc, total), n in spans.items():
            match = [ids for ids, _ in wanted if len(ids) == total and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc]
            assert match
            for p in range(start, start + length):
                cover[total, p] += n
        for ids, _ in wanted:
            same = sum(n for other, n in wanted if len(other) == len(ids))
            assert all(cover[len(ids), p] == same for p in range(len(ids)))
    assert sum(p["length"] for p in rows) == sum(len(ids) * n for (_, ids), n in left.items())
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("hot", [0, 120])
def test_packing(spark, hot):  # noqa: ANN001
    rnd = random.Random(3)
    docs = [(i, prose(rnd, int(rnd.lognormvariate(5, 1.2)))) for i in range(150)] + [(500 + i, "same text " * 40) for i in range(hot)]
    docs += [(900, None), (901, ""), (902, "w1 " * 9000), (903, " " * 1_200_000), (904, "\n"), (905, "é" * 50_000), (0, docs[0][1]), (0, docs[0][1]), (0, "other text under a repeated id"), (None, "no id"), *[(920 + i, t) for i, t in enumerate(TEXTS)]]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, length string")
    got = [r.asDict() for r in packing.pack(df, tokenizer_path()).collect()]
    assert check_packing(got, docs, packing.CAPACITY) == 0
    assert packing.pack(df.limit(0), tokenizer_path()).collect() == []
    small = [r.asDict() for r in packing.pack(df, tokenizer_path(), capacity=64).collect()]
    assert check_packing(small, docs, 64) == 0


def test_nnls_solves_exact_histograms():
    columns = [(1, 7), (2, 6), (4, 4), (1, 2, 5)]
    want = np.array([3.0, 0.0, 5.0, 2.0])
    target = np.zeros(9)
    for c, x in zip(columns, want):
        for n in c:
            target[n] += x
    assert np.allclose(packing.nnls(columns, target, 3000), want, atol=0.02)
    plan = packing.plan_of({1: 5, 7: 3, 4: 10, 2: 2, 5: 2}, 8, step=1)
    assert plan["split"] == {} and sum(t for _, t in plan["whole"]) == 10


def sets_of(text: str | None) -> frozenset:
    w = plain_words(text)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def plain_links(docs: list[tuple]) -> list[tuple]:
    sets = [sets_of(t) for _, t in docs]
    n = len(docs)
    links = [0] * n
    head = list(range(n))

    def top(k: int) -> int:
        while head[k] != k:
            k = head[k]
        return k

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                head[top(a)] = top(b)
            elif docs[a][0] is not None and docs[a][0] == docs[b][0]:
                head[top(a)] = top(b)
    least: dict[int, int] = {}
    for a in range(n):
        if docs[a][0] is not None:
            least[top(a)] = min(least.get(top(a), docs[a][0]), docs[a][0])
    return sorted(((docs[a][0], links[a], least.get(top(a))) for a in range(n)), key=str)


def near_docs() -> list[tuple]:
    rnd = random.Random(4)
    docs = [(i, prose(rnd, rnd.randint(0, 150))) for i in range(120)]
    nxt = 1000
    for size, n in ((60, 60), (200, 300), (90, 4), (400, 8)):
        base = prose(rnd, size).split()
        for _ in range(n):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, size // 40))):
                own[rnd.randrange(size)] = rnd.choice(VOCABULARY)
            docs.append((nxt, " ".join(own)))
            nxt += 1
    docs += [(5000 + i, docs[130][1].upper()) for i in range(50)]
    docs += [(900, None), (901, ""), (902, "..."), (903, "w1 w2 w3"), (904, "W1, w2; w3"), (905, prose(rnd, 20_000)), (None, docs[125][1]), (None, "unique words without any id at all here"), (None, None)]
    rnd.shuffle(docs)
    return docs


def test_near_join(spark):  # noqa: ANN001
    docs = near_docs()
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, class_id string, n int")
    got = near_join.near_join(df)
    assert sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in got.collect()), key=str) == plain_links(docs)
    kept = near_join.keep_one(df)
    assert kept.columns == df.columns
    wanted = {c for i, _, c in plain_links(docs) if i is not None}
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(wanted)
    assert near_join.near_join(df.limit(0)).collect() == [] and near_join.keep_one(df.limit(0)).collect() == []


def test_repeated_ids_are_one_document(spark):  # noqa: ANN001
    rnd = random.Random(5)
    a, b = prose(rnd, 50), prose(rnd, 50)
    docs = [(1, a), (1, b), (1, a), (2, a), (3, b), (4, prose(rnd, 50))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["class_id"] for r in near_join.near_join(df).where("doc_id < 4").collect()} == {1}
    # keep_one judges rows: each of the two texts under id 1 stands for its own class.
    assert sorted(map(tuple, near_join.keep_one(df).collect())) == sorted([(1, a), (1, b), (4, docs[5][1])])


def test_rows_without_an_id_or_with_a_repeated_one(spark):  # noqa: ANN001
    rnd = random.Random(6)
    a, b, c = prose(rnd, 60), prose(rnd, 60), prose(rnd, 60)
    docs = [(None, a, 1), (None, a + " w1", 2), (None, b, 3), (5, b, 4), (6, c, 5), (6, None, 6), (6, "", 7), (None, "...", 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string, class_id int")
    assert sorted(r["class_id"] for r in near_join.keep_one(df).collect()) in ([1, 4, 5, 6, 7, 8], [2, 4, 5, 6, 7, 8])
    bench = spark.createDataFrame([(1, b)], "item_id long, text string")
    assert sorted(r["class_id"] for r in decontaminate.clean(df, bench).collect()) == [1, 2, 5, 6, 7, 8]
    assert near_join.keep_one(df.limit(0)).collect() == [] == decontaminate.clean(df.limit(0), bench).collect()
    english = "the people of the town went to the market and they bought all that was there for the children of the house"
    rows = [(None, english, "en", "s", 1), (1, english, "en", "s", 2), (1, "1234 5678", "en", "s", 3), (None, "", "en", "s", 4), (None, None, None, None, 5), (1, english * 2_000, "en", "s", 6)]
    judged = langid.accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, accepted int"))
    assert sorted(r["accepted"] for r in judged.collect()) == [1, 2, 6]


def test_without_broadcast(spark, monkeypatch):  # noqa: ANN001
    from tidemark.llm import common

    docs = near_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(near_join, "small", lambda t, *_, **__: t)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in near_join.near_join(df).collect()), key=str) == plain_links(docs)


def test_bayesian_bound():
    least = near_join.least_matches(0.8, 1e-9)
    n = np.arange(near_join.STEP, near_join.VALUES + 1, near_join.STEP)
    assert (least < 0.8 * n).all() and (np.diff(least) > 0).all()
    rng = np.random.default_rng(6)
    draws = rng.random((20_000, near_join.VALUES)) < 0.8
    lost = np.zeros(len(draws), bool)
    for k, m in zip(n, least):
        lost |= draws[:, :k].sum(1) < m
    assert not lost.any()


def test_components(spark):  # noqa: ANN001
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    head: dict[int, int] = {}
    top = lambda k: k if head.get(k, k) == k else top(head[k])
    for a, b in edges:
        x, y = top(a), top(b)
        if x != y:
            head[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: top(k) for k in nodes}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_pipeline(spark, tmp_path):  # noqa: ANN001
    import corpus_pipeline

    english = "the house and the garden with old stones that were there when they came back from town in summer to see what had become of it all".split()
    rnd = random.Random(8)
    speak = lambda n: " ".join(rnd.choice(english) for _ in range(n))
    item = speak(14)
    docs = []
    for i in range(60):
        docs.append((i, "Menu line\n" + speak(rnd.randint(40, 200)), "en", "src0", 0))
    docs.append((100, docs[3][1].upper(), "en", "src0", 0))
    docs.append((101, speak(30) + " " + item, "en", "src1", 0))
    docs += [(102, "", "en", "src0", 0), (103, None, "en", "src0", 0), (104, "12 34 !!", "en", "src1", 0)]
    df = spark.createDataFrame(docs, DOCS)
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    wanted = [(i, t.removeprefix("Menu line\n")) for i, t, *_ in docs if i < 60]
    assert check_packing(got, wanted, packing.CAPACITY) == 0
    assert {r["doc_id"] for r in got} == set(range(60))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "benchmark", "pack"]
    stage = df
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, folder)
        assert stage.columns == df.columns
    empty = df.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, folder).collect() == []


def test_pipeline_lines_drops_rare_boilerplate_of_every_language(spark):  # noqa: ANN001
    import corpus_pipeline

    menus = {"en": "Read more of our stories", "fr": "Lire la suite de l'article", "de": "Alle Rechte sind vorbehalten", "es": "Todos los derechos reservados"}
    docs = [(i, "\n".join([f"own line of page {i}", *["Les."] * (i % 20 == 0), *[m for k, m in enumerate(menus.values()) if i % 40 == k]]), "en", "src0", 0) for i in range(400)]
    docs.append((900, "\n".join(menus.values()), "en", "src0", 0))
    df = spark.createDataFrame(docs, DOCS)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert set(got) == set(range(400))  # the page of menus alone is gone
    assert all(t == f"own line of page {i}" + "\nLes." * (i % 20 == 0) for i, t in got.items())  # a short line needs RATIO


def test_tidy(spark):  # noqa: ANN001
    from tidemark.llm import common

    path = common._written
    table = common.cut(spark.range(3).select("id"))
    folder = path[-1]
    assert table.count() == 3
    common.tidy(spark)
    assert not path
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(folder).count()
