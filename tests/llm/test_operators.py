"""The operators against brute force on small tables, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from annalist.llm import decontamination, html, jaccard, language, neighbours, packing, quality, suffixes, toxicity, warc
from annalist.llm.common import read

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, cuts string, k1 bigint, score double"


def words(n, seed, size=300):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) if r.random() < 0.9 else f"w{r.randint(0, size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, passage = words(120, 1), words(90, 2)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    for i in range(0, 120, 6):
        far[i] = f"x{i}"
    return [base, base, " ".join(near), " ".join(far), words(30, 3) + " " + passage + " " + words(20, 4), passage + "\n" + words(9, 5), "", None, "one", "One", "a b c d", words(9000, 6), "é" * 900, "x" * 1200, words(12, 7)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 5, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, words(50, 8), None, None, None, None, None, None)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_jaccard(docs, texts, none):
    sets = [shingle_set(t) for t in texts]
    best = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    best[i] = min(best[i], best[j])
    got = jaccard.join(docs).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(s), best[i]) for i, s in enumerate(sets)}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.join(none).count() == 0


def test_region_split_is_connected():
    def near(p, others):
        return np.abs(others - p) <= 1

    assert len(jaccard.split(50, near)) == 49
    assert jaccard.split(3, lambda p, o: np.zeros(len(o), bool)) == []


def removed(all_texts, length):
    data = [(t or "").encode() for t in all_texts]
    n = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append((int(hit.sum()), hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram", [(400, 100), (40, 12)])
def test_suffixes(docs, texts, none, length, gram):
    want = removed([*texts, texts[4], words(50, 8)], length)
    for r in suffixes.mark(docs, length, gram).collect():
        text = (r.text or "").encode()
        cut = suffixes.merged([(c.begin, c.end) for c in r.cuts or ()])
        assert (sum(b - a for a, b in cut), hashlib.sha256(suffixes.kept(text, cut)).hexdigest()) == want[r.doc_id if r.doc_id is not None else -1]
    assert suffixes.remove(none, length, gram).count() == 0
    assert suffixes.remove(docs, length, gram).schema == docs.schema


def test_many_suffixes_of_one_gram(monkeypatch):
    """Contexts compared pair by pair, by a matrix of common lengths, and split by split: one answer, zero bytes in the text too."""
    rng = np.random.default_rng(1)
    right, left = rng.integers(0, 2, (150, 24)).astype(np.uint8), rng.integers(0, 2, (150, 16)).astype(np.uint8)
    right[:, :8] = 0
    n, m = rng.integers(8, 25, 150), rng.integers(0, 17, 150)
    right[75:], n[75:], left[75:, :8] = right[:75], n[:75], left[:75, :8]
    right[np.arange(24) >= n[:, None]] = 0
    left[np.arange(16) >= m[:, None]] = 0
    found = []
    for pairs, wide in ((1000, 1000), (8, 1000), (8, 8)):
        monkeypatch.setattr(suffixes, "PAIRS", pairs)
        monkeypatch.setattr(suffixes, "WIDE", wide)
        found.append(suffixes.spans(right, left, n, m, 24))
    assert all((f[0] == found[0][0]).all() and (f[1] == found[0][1]).all() for f in found) and found[0][0].any()
    order = suffixes.multikey_order(right)
    assert [bytes(r) for r in right[order]] == sorted(bytes(r) for r in right)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    rows = packing.pack(docs, size=64, with_ids=True).collect()
    sequences: dict = {}
    by_doc: dict = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 64
    for r in docs.collect():
        if r.doc_id not in (4, None):
            assert [i for _, ids in sorted(by_doc[r.doc_id]) for i in ids] == [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
    assert sum(1 for s in sequences.values() if sum(n for _, n in s) < 64) <= 3
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("text", ["Hello, WORLD's  don't\nÉtre tab\tx y <|endoftext|> 12a ΑΣ İx ﬁ éé 中文 \x00\x1c", "", "...!!!", "Ǆ ŐŐ ß"])
def test_words_are_the_tokenizers(text):
    w = packing.Words(packing.vocabulary())
    assert np.frombuffer(w(text), "<u4").tolist() == w.whole.encode(text, add_special_tokens=False).ids


def test_decontamination(spark, docs, none):
    item = words(120, 1).split()
    bench = spark.createDataFrame([(1, " ".join(item[10:22]).upper()), (2, "ONE"), (3, None), (4, "..."), (5, " ".join(item[10:22]))], "item_id bigint, text string")
    for bound in (1 << 20, 60):
        got = {r.doc_id: r for r in decontamination.find(docs, bench, broadcast_bytes=bound).collect()}
        assert got[0].hits == list(range(10, 22)) and got[0]["items"] == ["1", "5"] and got[8]["items"] == ["2"] and got[9].hits == [0]
        assert not got[7].hits and got[7].n_words == 0
    clean = decontamination.decontaminate(docs, bench).where("doc_id = 0").first()
    assert len(clean.text.split()) == 108 and clean.cuts == "clash"
    assert 0 not in [r.doc_id for r in decontamination.decontaminate(docs, bench, how="documents").collect()]
    assert decontamination.find(none, bench).count() == 0


def test_warc(spark):
    big = "<p>" + "ä" * 800
    rows = [(1, "http://a/1", big), (2, None, big), (2, None, big), (3, "http://a/3", "small"), (4, "http://a/4", "small"), (5, "http://a/\n5", None), (None, "u", big + "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(warc.write(pages)).collect())
    n = len(big.encode())
    assert got == sorted([(1, "revisit", 2, n), (2, "response", None, n), (2, "revisit", 2, n), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (0, "response", None, n + 1)], key=lambda x: (x[0], x[1]))
    assert warc.read_records(warc.write(pages.limit(0))).count() == 0
    assert list(warc.ranges([(0, 10), (10, 10), (200, 5)], gap=50, most=100)) == [[0, 1], [2]]


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0] * 3), (5, x[5].tolist()), (None, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    v = neighbours.usable(df)
    got = neighbours.search(v, v.where("vec_id % 20 = 0").dropDuplicates(["vec_id"])).collect()
    assert {r.query_id for r in got} == set(range(0, 600, 20))
    hit = 0
    for q in range(0, 600, 20):
        s = (x.astype(np.float64) @ x[q].astype(np.float64)).tolist()
        want = [i for i in np.lexsort((np.arange(600), -np.round(s, 9))).tolist() if i != q][:20]
        own = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [k for k, _ in own] == list(range(1, 21))
        hit += len({i for _, i in own} & set(want))
    assert hit / 600 >= 0.9
    assert neighbours.search(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_of_odd_rows(spark, kind):
    """Copies, tight groups, queries far from all others: the answer is that of brute force, ties to the smaller id."""
    rng = np.random.default_rng(1)
    groups = rng.integers(-3, 4, size=(12, 8)) * 4
    x = np.concatenate([groups[rng.integers(0, 12, 3000)] + rng.integers(-1, 2, size=(3000, 8)), rng.integers(-40, 41, size=(40, 8))])
    x[1::3], x[:3000:100] = x[1], -x[1]
    x = x[rng.permutation(len(x))].astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate((x + (2.0**-20 if kind == "double" else 0)).tolist())], f"vec_id bigint, embedding array<{kind}>")
    v = neighbours.usable(df)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(v, v.where("vec_id % 20 = 0")).collect())
    want = []
    for q in range(0, len(x), 20):
        if x[q].any() or kind == "double":
            s = (x + (2.0**-20 if kind == "double" else 0)) @ (x[q] + (2.0**-20 if kind == "double" else 0))
            near = [i for i in np.lexsort((np.arange(len(x)), -s)).tolist() if i != q and (x[i].any() or kind == "double")][:20]
            want += [(q, k + 1, i) for k, i in enumerate(near)]
    assert got == want


PAGE = "<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>menu {0}</a></ul></nav><div class=ad>buy {0}</div>{1}<h1>Title {0}</h1><p>Text&nbsp;of <b>page</b> {0} &amp; more<br>lines<p>second {0}</p><div class='comments'>first {0}!</div>{2}<footer>&copy; all</footer></body>"


def test_html(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i, "<article>", "</article>")) for i in range(6)] + [(10 + i, f"http://g.example/{i}", PAGE.format(i, "<div id=m>", "</div>")) for i in range(6)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://h.example/9", "<p>cut off <b"), (0, "http://h.example/0", rows[0][2])]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == got[10 + i] == f"Title {i} Text of page {i} & more lines second {i}"
    assert got[20] == got[21] == "" and got[22].startswith("cut off")


def extracted(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_html_keeps_all_slots(spark):
    page = "<html><body><div class=top>Site name</div><h1>Title {0}</h1><div class=lead>Lead {0}</div><div class=content>{1}<ul class=refs><li><a href=r>Source {0}</a></ul></div><div class=more><ul><li><a href=x>Other {0}</a></ul></div></body>"
    body = [" ".join(f"word{i} text{k}" for k in range(40)) for i in range(8)]
    got = extracted(spark, [(i, f"http://s.example/{i}", page.format(i, f"<p>{body[i]}</p>" * (1 + i % 2))) for i in range(8)])
    assert got == {i: " ".join([f"Title {i}", f"Lead {i}", *[body[i]] * (1 + i % 2), f"Source {i}"]) for i in range(8)}


def test_html_slots_decide_without_telling_names(spark, monkeypatch):
    """No article, no main, no class that tells: the template's slots decide, and one host's class names are not telling."""
    page = "<html><body><div class=a1><a href=1>Start {0}</a><a href=2>Topic {0}</a></div><div class=b2><h2><a href=x>Head {0}</a></h2><p>{1}</p><p>Tail {0}</p></div><div class=c3>Made by the house</div><div class=d4><div><a href=y>More {0}</a></div></div></body>"
    odd = "<html><body class=x><div class='popup wide'><h1>Head {0}</h1><p>{1}</p></div><div class=comments><p>{1} said {0} and more of it {1}</p></div></body>"
    body = [" ".join(f"word{i} text{k}" for k in range(30)) for i in range(8)]
    rows = [(i, f"http://plain.example/{i}", page.format(i, body[i])) for i in range(8)] + [(20 + i, f"http://odd.example/{i}", odd.format(i, body[i])) for i in range(8)]
    rows += [(40, "http://two.example/1", odd.format(1, body[1])), (41, "http://two.example/2", page.format(2, body[2]))]
    frame = spark.createDataFrame([(*r, "clash", "x") for r in rows], "page_id bigint, url string, html string, text string, host string")
    got = {r.page_id: (r.text, r.by_template) for r in html.extract(frame).collect()}
    assert {i: got[i] for i in range(8)} == {i: (f"Head {i} {body[i]} Tail {i}", True) for i in range(8)}
    assert {i: got[20 + i] for i in range(8)} == {i: (f"Head {i} {body[i]}", True) for i in range(8)}
    assert got[40] == (f"Head 1 {body[1]}", False) and got[41] == (f"Start 2Topic 2 Head 2 {body[2]} Tail 2 Made by the house More 2", False)
    assert html.extract(frame.limit(0)).count() == 0
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert {r.page_id: (r.text, r.by_template) for r in html.extract(frame).collect()} == got


def test_html_very_long_and_cut_pages(spark):
    long = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(30_000)) + "<p>end <b"
    got = extracted(spark, [(1, "http://l.example/", long), (2, "http://l.example/", "<" * 2000 + "x"), (3, "http://l.example/", "<p>" * 3000 + "deep")])
    assert got[1].startswith("paragraph 0 paragraph 1 ") and "paragraph 29999 end" in got[1] and got[3] == "deep"


def test_html_looks_through_forms_and_telling_names(spark):
    """A page in one form, a main block with a telling class, class names that only contain a telling word; small forms and notices go."""
    form = "<html><body><form id=aspnet><nav><a href=x>Menu {0}</a></nav><div class=main-text><h1>Head {0}</h1><p>{1}</p><p>More {0}</p></div><div class=newsletter><p>Mail {0}</p></div></form><footer>House</footer></body>"
    box = "<html><body><div class='share-price article'><p>Price {0}</p></div><div class=notice-period><p>Period {0}</p></div><p>{1}</p><div class=cookie-banner><p>Cookies {0}</p></div><form><p>Name {0}</p><p>Mail {0}</p></form><div class=ad-slot>Buy {0}</div></body>"
    login = "<html><body><form><div>Name</div><div>Password</div></form></body>"
    body = [" ".join(f"word{i} text{k}" for k in range(30)) for i in range(6)]
    rows = [(i, f"http://form.example/{i}", form.format(i, body[i])) for i in range(6)] + [(10, "http://one.example/", form.format(1, body[1])), (11, "http://two.example/", box.format(1, body[1])), (12, "http://three.example/", login)]
    rows += [(20 + i, f"http://box.example/{i}", box.format(i, body[i])) for i in range(6)]
    got = extracted(spark, rows)
    assert {i: got[i] for i in range(6)} == {i: f"Head {i} {body[i]} More {i}" for i in range(6)} and got[10] == got[1]
    want = [f"Price {i} Period {i} {body[i]}" for i in range(6)]
    assert got[11] == want[1] and got[12] == "" and [got[20 + i] for i in range(6)] == want
    assert [html.tells(c, html.WORDS) for c in ("popup wide", "site-footer", "ad-slot ", "share-price", "notice-period", "sidebar2", "breadcrumb")] == [True, True, True, False, False, True, True]


class Plain(HTMLParser):
    """A second extractor, by tags alone: blocks of text outside of what the given pages mark."""

    GONE = {"nav", "footer", "aside", "script", "style", "form", "head", "header"}

    def __init__(self):
        super().__init__()
        self.stack, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            words = set(" ".join(v or "" for k, v in attrs if k in ("class", "id")).split())
            self.stack.append((tag, bool(words & {"ad", "ads", "comments", "comment", "cookie", "notice", "sidebar"}) or tag in self.GONE and not (tag == "header" and any(t == "article" for t, _ in self.stack))))
        if tag not in html.INLINE:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.stack) and self.stack.pop()[0] != tag:
            pass
        if tag not in html.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if not any(gone for _, gone in self.stack):
            self.blocks[-1] += data


def test_html_equals_a_plain_extractor_on_all_given_pages(spark):
    pages = read(spark, SF, "pages")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        assert got[r.page_id] == " ".join(b for b in (" ".join(b.split()) for b in plain.blocks) if b), r.page_id


def test_html_articles_are_a_hint(spark):
    story = "<html><body><article><h1>Title {0}</h1><p>Story {0}</p>{1}<p>All rights with the house</p></article></body>"
    cards = "<html><body><article><a href=x>Card {0}</a></article><div class=text><p>Main text {0}</p></div><article>Teaser {0}</article></body>"
    rows = [(i, f"http://a.example/{i}", story.format(i, "<p>More</p>" * (i % 3) if i else "")) for i in range(8)] + [(20 + i, f"http://c.example/{i}", cards.format(i)) for i in range(6)]
    rows += [(40, "http://alone.example/", cards.format(9))] + [(50 + i, f"http://copies.example/{i}", "<html><body><article><h1>Once</h1><p>The same text</p></article></body>") for i in range(6)]
    got = extracted(spark, rows)
    assert {i: got[i] for i in range(8)} == {i: " ".join([f"Title {i}", f"Story {i}", *["More"] * (i % 3)]) for i in range(8)}
    assert all(got[20 + i] == f"Card {i} Main text {i} Teaser {i}" for i in range(6)) and got[40] == "Card 9 Main text 9 Teaser 9"
    assert all(got[50 + i] == "Once The same text" for i in range(6))


def test_classifiers(spark, none):
    rng = random.Random(0)
    sentence = lambda bad: " ".join(["Good words, here."] * 5 + rng.sample("the and of river stone cloud table".split(), 4) + (["nasty"] if bad else []))
    rows = [(sentence(i % 4 == 0), int(i % 4 == 0)) for i in range(200)]
    m = toxicity.Model.fit(rows)
    s = m.scores([sentence(True), sentence(False), "", None, "nastyy"])
    assert s[0] > 0.5 > s[1] and s[2] == s[3] < 0.5 and s[4] > s[1]
    model = language.Model.fit([(words(20, i), "en") for i in range(40)] + [(words(20, i).replace("a", "ö").replace("e", "ü"), "de") for i in range(40)])
    assert model.predict("abc ace bed")[0] == "en" and model.predict("öüö böüö")[0] == "de"
    assert model.predict(None)[0] == model.predict("12 !?")[0] == "und" and language.Model.fit([]).predict("a")[0] == "und"
    assert language.codewords(9).shape[0] == 9 and language.codewords(4).shape == (4, 7)
    good, bad = ["Plain text, with stops. And more of it. " * k for k in range(1, 40)], ["### $$$ |a| |b| WORD!! " * k for k in range(1, 20)]
    q = quality.Model.fit(good, good + bad)
    got = q.scores([good[7].encode(), bad[7].encode(), b"", None])
    assert got[0] > got[1] and got[2] == got[3] == 0.0
    assert language.identify(none, model).count() == toxicity.score(none, m).count() == quality.score(none, q).count() == toxicity.reject(none, m).count() == 0


def test_toxicity_learns_nothing_from_texts_without_words():
    m = toxicity.Model.fit([("", 0), ("..", 1)])
    assert m.scores(["", "a b"]) == [0.4, 0.5]


def test_toxicity_in_parts_is_the_same(monkeypatch):
    rows = [(f"plain words number {i} of some text", 0) for i in range(40)] + [(f"you awful scumbag{i} person", 1) for i in range(20)]
    whole = toxicity.Model.fit(rows)
    monkeypatch.setattr(toxicity, "PART", 7)
    parts = toxicity.Model.fit(rows)
    assert (whole.logits == parts.logits).all() and whole.bias == parts.bias
