"""Each opN query on tables with nulls, empty and very long texts, ties, repeated rows and clashing columns, against SQL or brute force."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from annalist.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "benchmark", "labels", "embeddings", "pages")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, cuts string, k1 bigint, component_id bigint, row string"
LABELS = "doc_id bigint, quality int, toxic int, text string, score double"
ITEMS = "item_id bigint, text string, hits string, doc_id bigint"
VECTORS = "vec_id bigint, embedding array<float>, rank int, query_id bigint, score double"
PAGES = "page_id bigint, url string, html string, host string, text string, payload_digest string, refers_to bigint"
EN, DE = "the and of river stone cloud table window garden letter".split(), "der und von fluss stein wolke tisch fenster garten brief".split()


def text_of(rng, words, n, toxic=False):
    out = [rng.choice(words) + rng.choice(["", "", "s", "er", ","]) for _ in range(n)]
    if toxic:
        out[rng.randrange(n)] = rng.choice(["scumbag", "scumbags", "scumb4g"])
    return " ".join(out).capitalize() + "."


def rows_of(seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(240):
        bad, toxic = i % 3 == 0, i % 6 == 1
        text = text_of(rng, EN if i % 2 else DE, rng.randint(20, 60), toxic)
        docs.append((i, " ".join(f"{w}### $$$" for w in text.split()) if bad else text, "en" if i % 2 else "de"))
        if i % 5:
            labels.append((i, int(not bad), int(toxic), "clash", 0.5))
    passage = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(120))
    docs += [(300, passage, None), (301, f"{text_of(rng, EN, 30)} {passage}", "en"), (302, passage, "en"), (303, None, "en"), (304, "", "de"), (305, "..", None), (306, " ".join(f"long{i}" for i in range(60_000)), "en"), (306, "again", "en"), (None, "no id", "en"), (307, passage.replace("w1", "W1") + " x", "en")]
    labels += [(0, None, None, None, None), (999, 1, 0, None, None)]
    items = [(1, " ".join(passage.split()[3:15]), "c", 1), (2, "one", "c", 2), (3, None, "c", 3), (3, "", "c", 3), (4, " ".join(passage.split()[3:15]).upper(), "c", 4)]
    gen = np.random.default_rng(seed)
    x = gen.normal(size=(220, 8)).astype(np.float32)
    x[50:90] = x[50]
    vectors = [(i, v.tolist(), 1, 2, 0.5) for i, v in enumerate(x)] + [(300, None, 1, 1, 1.0), (320, [0.0] * 8, 1, 1, 1.0), (340, [float("nan")] * 8, 1, 1, 1.0), (360, [1.0, None] * 4, 1, 1, 1.0)]
    big = "<html><body><nav><a href=1>x</a></nav><article><p>" + "ä" * 900 + "</p></article></body></html>"
    pages = [(1, "http://a.example/1", big), (2, None, big), (3, "http://a.example/3", "small"), (4, "http://a.example/4", None), (5, "http://a.example/5", ""), (6, "http://a.example/6", big + "<p>" + "y " * 100_000)]
    return {"documents": [(i, t, lang, "s", len(t or ""), 0.5, "c", 7, 8, "r") for i, t, lang in docs], "labels": labels, "benchmark": items, "embeddings": vectors, "pages": [(*p, "h", "t", "d", 9) for p in pages]}


SCHEMAS = dict(zip(TABLES, (DOCS, ITEMS, LABELS, VECTORS, PAGES), strict=True))


@pytest.fixture(scope="module")
def data():
    return rows_of()


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    for name in TABLES:
        spark.createDataFrame(data[name], SCHEMAS[name]).repartition(3).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.fixture(scope="module")
def results(spark, folders):
    return {name: [r.asDict() for r in q(spark, folders[0]).collect()] for name, q in QUERIES.items()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders[1]).count() == 0


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] in ("op1", "op2", "op4", "op6", "op7", "op8", "op12", "op13")])
def test_every_document_has_its_row(results, data, name):
    assert Counter(r["doc_id"] for r in results[name]) == Counter(r[0] for r in data["documents"])


def test_languages(results, data):
    lang = {r[0]: r[2] for r in data["documents"] if r[0] is not None}
    assert all(r["held_out"] == (r["doc_id"] is not None and remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in results["op1_language"])
    assert {r["doc_id"] for r in results["op1_language"] if r["lang_pred"] == "und"} == {303, 304, 305}
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in results["op1_language"] if r["doc_id"] is not None and r["doc_id"] < 240)


def test_predictions_come_from_texts_alone(spark, folders, tmp_path):
    """Other ids, languages and sources of held-out rows, and their labels, change no score of theirs."""
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    for name, m, rest in (("op1_language", 4, 2), ("op6_toxicity", 5, 0), ("op7_quality", 4, 2)):
        held = f"pmod(crc32(cast(cast(doc_id as string) as binary)), {m}) = {rest}"
        at = tmp_path / name
        docs.selectExpr("doc_id", "text", f"if({held}, 'xx', lang) as lang", f"if({held}, 'other', source) as source").write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{folders[0]}/labels.parquet").selectExpr("doc_id", f"if({held}, 1 - quality, quality) as quality", f"if({held}, 1 - toxic, toxic) as toxic").write.parquet(f"{at}/labels.parquet")
        one, two = ({(r.doc_id, r.score) for r in QUERIES[name](spark, f).where("held_out").collect()} for f in (folders[0], str(at)))
        assert one == two and one


def test_scores(results, data):
    label = {r[0]: (r[1], r[2]) for r in data["labels"]}
    for name, m, rest, at, which in (("op6_toxicity", 5, 0, 0.5, 1), ("op7_quality", 4, 2, 0.7, 0)):
        rows = results[name]
        assert all(r["held_out"] == (r["doc_id"] is not None and remainder(r["doc_id"], m) == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at) for r in rows)
        known = [(r["predicted"], label[r["doc_id"]][which]) for r in rows if r["held_out"] and r["doc_id"] in label and label[r["doc_id"]][which] is not None]
        assert len(known) > 20 and sum(a == b for a, b in known) / len(known) >= 0.9


def test_shingle_classes(results, data):
    from tests.llm.test_operators import shingle_set

    ids = [r[0] for r in data["documents"] if r[0] is not None]
    sets = [shingle_set(r[1]) for r in data["documents"] if r[0] is not None]
    best = dict(zip(ids, ids, strict=True))
    linked = [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids[:i]) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(4):
        for a, b in linked:
            best[a] = best[b] = min(best[a], best[b])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in results["op2_jaccard"] if r["doc_id"] is not None)
    assert got == Counter((i, len(s), best[i]) for i, s in zip(ids, sets, strict=True))


def test_nearest(results, data):
    """All lists are probed on a table as small as this one, so the answer is exact: ties go to the smaller id, scores are in double precision."""
    x = {r[0]: np.array(r[1], np.float64) for r in data["embeddings"] if r[0] < 300}
    got: dict = {}
    for r in results["op3_neighbours"]:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in x if i % 20 == 0}
    hit = 0
    for q, own in got.items():
        own.sort()
        want = sorted(((-float(np.dot(x[q], v)), i) for i, v in x.items() if i != q))[:20]
        assert [k for k, _, _ in own] == list(range(1, 21)) and all(abs(s - float(np.dot(x[q], x[i]))) < 1e-9 for _, i, s in own)
        assert [(-round(s, 9), i) for _, i, s in own] == sorted((-round(s, 9), i) for _, i, s in own)
        hit += len({i for _, i, _ in own} & {i for _, i in want})
    assert hit / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(results, folders, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folders[0]}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    columns = want.columns
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(key(r) for r in want.fetchall()) == sorted(key([r[c] for c in columns]) for r in results[name])


def test_suffixes(results, data):
    texts = [(r[1] or "").encode() for r in data["documents"]]
    short = [t for t in texts if len(t) < 100_000]  # the very long text repeats nothing: its windows are left out of the count
    n = Counter(t[i : i + 400] for t in short for i in range(len(t) - 399))
    words = Counter(tuple(t.split()[i : i + 51]) for t in short for i in range(len(t.split()) - 50))
    want = Counter()
    for r, t in zip(data["documents"], texts, strict=True):
        hit, own = np.zeros(len(t), bool), t.split()
        said = np.zeros(len(own), bool)
        if t in short:
            for i in range(len(t) - 399):
                if n[t[i : i + 400]] > 1:
                    hit[i : i + 400] = True
            for i in range(len(own) - 50):
                if words[tuple(own[i : i + 51])] > 1:
                    said[i : i + 51] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) > 0).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~hit])
        want[(r[0], len(t), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest(), int(said.sum()))] += 1
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
    assert Counter(tuple(r[c] for c in names) for r in results["op8_suffixes"]) == want


def test_pages(results):
    got = {r["page_id"]: (r["text"], r["n_chars"], r["url"]) for r in results["op9_html"]}
    assert got[1] == ("ä" * 900, 900, "http://a.example/1") and got[2][2] is None and got[3] == ("small", 5, "http://a.example/3")
    assert got[4][:2] == got[5][:2] == ("", 0) and got[6][1] == 900 + 2 * 100_000


def test_packed(results, data):
    from tokenizers import Tokenizer

    from annalist.llm import packing

    t = Tokenizer.from_file(packing.vocabulary())
    by_doc: dict = {}
    at: dict = {}
    for r in results["op10_packing"]:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in at.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 4096
    for i, text, *_ in data["documents"]:
        if i not in (306, None):
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
            pieces = sorted(by_doc[i])
            assert sum(n for _, n, _, _ in pieces) == len(ids) == pieces[0][3]
            assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == c for a, n, c, _ in pieces)


def test_other_vocabularies_go_through_the_whole_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from annalist.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.known(packing.vocabulary()) and not packing.known(path)
    t = Tokenizer.from_file(path)
    for text in ("Hello  World's\nend", "", "é 中"):
        assert np.frombuffer(packing.Words(path)(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_phrases_and_misspellings_are_toxic():
    """A phrase of harmless words is learned as such, and unseen spellings share n-grams."""
    from annalist.llm import toxicity

    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice(["rotten", "apple", "idea", "today", "house", "green", "water", "stone"]) + rng.choice(["", "s"]) for _ in range(14))
    rows = []
    for i in range(600):
        words = plain().split()
        if i % 3 == 0:
            words[5:7] = ["rotten", "filth"] if i % 2 else ["nasty", "scoundrel"]
        rows.append((" ".join(words), int(i % 3 == 0)))
    m = toxicity.Model.chosen(rows)
    assert m.segment in toxicity.SEGMENTS
    clean, phrase, odd = m.scores([plain(), f"{plain()} nasty scoundrel {plain()}", f"{plain()} nastyy scoundrels {plain()}"])
    assert clean < 0.5 < phrase and odd > 0.5
    assert m.scores([" ".join([plain()] * 3000) + " nasty scoundrel"])[0] > 0.5


def test_decontamination_in_parts_is_the_same(spark, folders):
    from annalist.llm import decontamination

    docs, items = (spark.read.parquet(f"{folders[0]}/{t}.parquet") for t in ("documents", "benchmark"))
    for how in ("spans", "documents"):
        one, many = (Counter(map(str, decontamination.decontaminate(docs, items, how, broadcast_bytes=b).collect())) for b in (1 << 20, 50))
        assert one == many and one


def plain_runs(words, least=6, exponent=4):
    """Every period and place by comparing words one by one; a stretch with a smaller period is not counted again."""
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            own = words[start : i + q]
            if len(own) >= max(least, exponent * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((start, len(own), q))
            i += 1
    return sorted(out)


def test_runs_equal_plain_comparison(monkeypatch):
    """Short texts by all lags, and the same texts as if they were long."""
    from annalist.llm import periodic

    rng = random.Random(5)
    for case in range(600):
        words = [b"%d" % rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 70))]
        words += (words[-rng.randint(1, 9) :] * rng.randint(1, 6) + [b"end"]) * rng.randint(0, 2)
        want = plain_runs(words)
        for long in (2000, 0):
            monkeypatch.setattr(periodic, "LONG", long)
            assert periodic.runs(words) == want
    assert periodic.runs([b"a"] * 50_000) == [(0, 50_000, 1)] and periodic.runs([b"a", b"b"] * 25_000) == [(0, 50_000, 2)]
    assert periodic.runs([b"%d" % i for i in range(50_000)]) == []


def test_periodic(results, data):
    want = Counter()
    for i, text, *_ in data["documents"]:
        words = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        found = plain_runs(words) if len(words) < 50_000 else []
        gone = {j for s, m, q in found for j in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        milli = best[1] * 1000 // best[2] if found else None
        shas = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in found).encode(), b" ".join(w for j, w in enumerate(words) if j not in gone))]
        want[(i, len(found), *best, milli, *shas)] += 1
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert Counter(tuple(r[c] for c in names) for r in results["op13_periodic"]) == want and any(r["n_runs"] for r in results["op13_periodic"])


def test_collapse_and_find(spark):
    from annalist.llm import periodic

    docs = spark.createDataFrame([(1, "x  y " + "go on " * 5 + "z", 7), (2, "as  it\nis", 7), (3, None, 7), (4, "", 7), (5, "a b " * 4, 7)], "doc_id bigint, text string, runs int")
    assert {r.doc_id: (r.text, r.runs) for r in periodic.collapse(docs).collect()} == {1: ("x y go on z", 7), 2: ("as  it\nis", 7), 3: (None, 7), 4: ("", 7), 5: ("a b", 7)}
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs]) for r in periodic.find(docs).collect()}
    assert got == {1: (13, [(2, 10, 2)]), 2: (3, []), 3: (0, []), 4: (0, []), 5: (8, [(0, 8, 2)])}


def test_search_in_parts_and_small_blocks_is_the_same(spark, folders):
    from annalist.llm import lexical

    docs, items = (spark.read.parquet(f"{folders[0]}/{t}.parquet") for t in ("documents", "benchmark"))
    more = docs.where("doc_id < 240 and doc_id % 9 = 0").selectExpr("cast(doc_id as bigint) as item_id", "text")
    items = items.select("item_id", "text").unionByName(more)
    one, many = (sorted(map(tuple, lexical.search(docs, items, block=b, broadcast_bytes=size).collect()), key=str) for b, size in ((64, 1 << 20), (3, 700)))
    assert one == many and len({r[0] for r in one}) > 20


def test_mixing_over_many_shards(spark, monkeypatch):
    """Small shards and groups, so that blocks pass through both levels: near the targets, no word more than twice, cuts add up."""
    from annalist.llm import mixing

    monkeypatch.setattr(mixing, "GROUP", 4)
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 40, 90, 2500 if i % 50 == 0 else 60])), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    rows += [(900, None, "a"), (900, "", "a"), (None, "x " * 30, "b"), (None, "x " * 30, "b"), (901, "one two", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = mixing.mix(docs, block=16, shard=1 << 10).collect()
    again = mixing.mix(docs.repartition(5), block=16, shard=1 << 10).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by: dict = {}
    for r in got:
        taken = sum(c.length * c.times for c in r.cuts)
        assert taken <= 2 * r.size and all(0 <= c.start and c.start + c.length <= r.size and 1 <= c.times <= 2 for c in r.cuts)
        by.setdefault(r.source, [0, 0, r.target, r.source_size])
        by[r.source][0] += taken
        by[r.source][1] += r.size
    assert all(size == whole and target <= 2 * size for _, size, target, whole in by.values())
    assert all(abs(taken - target) <= max(0.02 * target, 4) for taken, _, target, _ in by.values())
    total = sum(v[1] for v in by.values())
    assert abs(sum(v[2] for v in by.values()) - 1.5 * total) < 1e-6
    # targets by raising one rate until the shares are used up
    names = [*sorted(s for s in by if s), None]
    weigh = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 3.0 * total
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(2 * by[s][1], rate * weigh[s]) for s in names) < 1.5 * total else (low, rate)
    assert all(abs(by[s][2] - min(2 * by[s][1], low * weigh[s])) < 1e-3 for s in names)


def test_highest_quotients(spark):
    """Quotas against walking through the seats one by one."""
    from annalist.llm import mixing

    rng = random.Random(4)
    rows = [(p, c, rng.choice([0, 1, 5, 100, 100, 3000]), rng.choice([0, 3, 40])) for p in range(6) for c in range(12)]
    seats = {p: s for p, _, _, s in rows}
    rows = [(p, c, w, seats[p]) for p, c, w, _ in rows]
    got = {(r.p, r.c): r.quota for r in mixing.apportioned(spark.createDataFrame(rows, "p int, c int, w bigint, seats bigint"), ["p"], ["c"], "w", "seats", "quota").collect()}
    want = {(p, c): 0 for p, c, *_ in rows}
    for p, n in seats.items():
        for _ in range(n):
            best = max((w / (2 * want[p, c] + 1), -c) for q, c, w, _ in rows if q == p)
            want[p, -best[1]] += 1
    assert got == want
