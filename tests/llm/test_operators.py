"""The operators against brute force, round trips and held-out labels."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from folio_spark.llm import jaccard
from folio_spark.llm.chat import format_chat, read_back
from folio_spark.llm.common import FREE, Scratch
from folio_spark.llm.decontaminate import align, contaminated, decontaminate
from folio_spark.llm.html import extract_text, main_text
from folio_spark.llm.lines import dedup_lines
from folio_spark.llm.packing import pack_documents, pack_group
from folio_spark.llm.quality import frequent, quality_rules
from folio_spark.llm.sharding import shard
from folio_spark.llm.toxicity import toxicity
from folio_spark.llm.urls import filter_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in zip(ids, texts)], DOCS)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(8, 90))] for _ in range(6)]
    passage = [r.choice(vocab) for _ in range(60)]
    out = [None, "", " \n\t ", "one two", "one two", "ONE two", "x"]
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 2, 5, 12])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.4:
            w += passage + [r.choice(vocab) for _ in range(r.randint(0, 25))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most", [1, 48])
def test_jaccard_components(spark, most):
    texts = corpus()
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").encode().lower())
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(frame(spark, texts), most=most).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_jaccard_second_index(spark, monkeypatch):
    """Without any token found frequent in the first pass, the exact second index must find the same."""
    monkeypatch.setattr(jaccard.survey, "__defaults__", (4_000_000, 10_000))
    test_jaccard_components(spark, 1)


def test_jaccard_edges(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    got = jaccard.jaccard_components(frame(spark, ["a b c d e f", "a b c d e f", None], [None, 4, 4]))
    assert sorted(map(str, got.collect())) == sorted(map(str, [(*x,) and __import__("pyspark").sql.Row(doc_id=x[0], n_shingles=x[1], component_id=x[2]) for x in [(None, 2, 4), (4, 2, 4), (4, 0, 4)]]))
    kept = jaccard.keep_one(frame(spark, ["a b c d e f", "a b c d e f", "z", None], [7, 4, 5, None]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 4), (False, 5), (True, 0)]


def test_line_dedup(spark):
    r = random.Random(3)
    lines = [" ".join(f"v{r.randrange(999)}" for _ in range(r.choice([3, 6, 12]))) for _ in range(14)]
    texts = [None, ""] + ["\n".join(r.choice(lines) if r.random() < 0.8 else r.choice(["", f"own {r.random()}"]) for _ in range(r.randint(1, 25))) for _ in range(40)]
    least = 15
    flat = [(i, k, p, line, n) for i, t in enumerate(texts) if t for ks in [[(p, x.strip()) for p, x in enumerate(t.split("\n")) if x.strip()]] for n in [len(ks)] for k, (p, line) in enumerate(ks)]
    gone = collections.defaultdict(set)
    for a, (i, k, _, _, n) in enumerate(flat):
        best = 0
        for b in range(a):
            _, k2, _, _, n2 = flat[b]
            e = 0
            while k + e < n and k2 + e < n2 and flat[a + e][3] == flat[b + e][3]:
                e += 1
            best = max(best, e)
        if best and sum(len(flat[a + j][3].split()) for j in range(best)) >= least:
            gone[i].update(flat[a + j][2] for j in range(best))
    want = {i: t and "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in enumerate(texts)}
    out = dedup_lines(frame(spark, texts), min_words=least)
    assert {r.doc_id: r.text for r in out.collect()} == want and any(gone.values())
    assert out.columns == [*DOCS.replace(",", "").split()[::2], "n_removed"]


def test_line_dedup_edges(spark):
    line = " ".join(f"v{i}" for i in range(60))
    got = dedup_lines(frame(spark, [line, line, line + "\nb", None, line], [1, 1, 2, 3, None])).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in got) == sorted([(1, line, 0), (1, line, 0), (2, "b", 1), (3, "", 0), (0, line, 0)])
    assert dedup_lines(frame(spark, [])).count() == 0


def test_html():
    page = '<body><nav><a href=x>menu</a></nav><div class="cookie-notice"><p>We, use, cookies</div><div id=c><h1>T &amp; U</h1><div><p>One,\n two &lt; three<br>four<p>five, six</div></div><aside><p>side</aside><section id="comments"><p>a, b, c, d, e</section><form><p>f</form><footer><p>x'
    assert main_text(page) == "T & U\nOne, two < three four\nfive, six"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("<article>" + "<p>word" * 50_000).count("\n") == 49_999


def test_html_scores():
    """Pages without article or main, against scores counted from the tree of an XML parser, paragraph by paragraph."""
    import xml.etree.ElementTree as ET

    r = random.Random(21)
    para = lambda n: " ".join(r.choice(["word", "other,", "thing", "more"]) for _ in range(n))

    def tree(depth):
        kids = [f"<p>{para(r.randint(1, 60))}</p>" if depth == 0 or r.random() < 0.6 else f"<div>{tree(depth - 1)}</div>" for _ in range(r.randint(1, 4))]
        return "".join(k if r.random() < 0.8 else f"<div><p><a href='x'>{para(9)}</a></p></div>" for k in kids)

    for _ in range(150):
        page = f"<html><body><nav><p>{para(90)}</p></nav>{tree(3)}</body></html>"
        root = ET.fromstring(page)
        up = {c: p for p in root.iter() for c in p}
        out = {e for n in root.iter("nav") for e in n.iter()}
        score = collections.defaultdict(float)
        for p in (e for e in root.iter("p") if e not in out):
            t, e = "".join(p.itertext()), p
            for k in (1, 2, 3):
                if (e := up.get(e)) is None or e.tag == "html" and k > 1:
                    break
                score[e] += (1 + t.count(",") + min(len(t) / 100, 3)) / k
        size = lambda e: sum(len(t) for x in e.iter() if x not in out for t in [x.text or ""])  # noqa: B023, E731
        link = lambda e: sum(size(a) for a in e.iter("a")) / size(e) if size(e) else 0  # noqa: E731, B023
        rate = {e: s * (1 - link(e)) for e, s in score.items()}
        depth = lambda e: 0 if e not in up else 1 + depth(up[e])  # noqa: B023, E731
        order = {e: i for i, e in enumerate(root.iter())}
        best = max(rate, key=lambda e: (round(rate[e], 9), -depth(e), -order[e]))
        while up[best].tag not in ("body", "html") and any(e is not best and up.get(e) is up[best] and rate[e] >= 0.5 * rate[best] and link(e) < 0.25 for e in rate):
            best = up[best]
        kept = {best} | {e for e in rate if up.get(e) is up[best] and rate[e] >= max(10, 0.2 * rate[best]) and link(e) < 0.25}
        lines = []
        for p in (e for e in root.iter("p") if e not in out):
            a, t = p, "".join(p.itertext())
            while a is not None and a not in kept:
                a = up.get(a)
            if a is not None or up[p] is up[best] and len(t) > 80 and link(p) < 0.25:
                lines.append(" ".join(t.split()))
        assert main_text(page) == "\n".join(lines if link(best) < 1 else [])


def test_html_containers():
    """The container is found by its points, whatever it is called; names only leave out."""
    body = "".join(f"<p>{'some words, of a paragraph ' * 6}{i}</p>" for i in range(4))
    want = "\n".join(" ".join(f"{'some words, of a paragraph ' * 6}{i}".split()) for i in range(4))
    links = "<div><ul>" + "<li><a href=x>a long link text, with commas, and more</a></li>" * 30 + "</ul></div>"
    for tag in ('div class="x"', "section", "td", 'div class="related-work"', 'div id="no-sidebar-text"'):
        assert main_text(f"<body>{links}<div class='ad-slot-2'>{body}</div><table><tr><{tag}>{body}</{tag.split()[0]}></table>{links}") == want
    assert main_text(f"<body><article><p>teaser</p></article><div>{body}</div>") == want
    assert main_text('<body><article><svg class="i"/><p>one two three</p><svg><text>no</text></svg><p>four <math><mi>x</mi></math></p></article></body>') == "one two three\nfour x"
    split = "".join(f"<div><p>{'part, of it ' * 20}{i}</p></div>" for i in range(3))
    assert main_text(f"<body><div><h1>Head</h1>{split}</div>{links}").split("\n")[0] == "Head"


P3 = "".join(f"<p>{'Some words, of a paragraph, that goes on for a good while and has commas, too, so that it scores. ' * 1}{i}</p>" for i in "abc")
T3 = "\n".join(f"Some words, of a paragraph, that goes on for a good while and has commas, too, so that it scores. {i}" for i in "abc")


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><section>{P3}</section><section><p>Tiny end.</p></section></article>", f"{T3}\nTiny end."),
        (f"<article><h1>Head</h1><p>Lead, short.</p><div>{P3}</div></article>", f"Head\nLead, short.\n{T3}"),
        (f"<article><div>{P3}</div><ul><li>one</li><li>two</li></ul></article>", f"{T3}\none\ntwo"),
        ("<article><p><a href=x>See the report</a></p></article>", "See the report"),
        ("<article><p>aa</p><div class='related-work'><p>bb, cc</p></div></article>", "aa\nbb, cc"),
        (f"<main><h1>Head</h1><div>{P3}</div><p>End <a href=x>here</a></p></main>", f"Head\n{T3}\nEnd here"),
        (f"<main><article><div>{P3}</div><p>End</p></article><section><p>Of another, matter</p></section></main>", f"{T3}\nEnd"),
        (f"<article><div>{P3}</div><ul><li><a href=x>More of it</a></li><li><a href=y>And more</a></li></ul></article>", T3),
        (f"<article><section>{P3}<section><table><tr><td>1</td><td>2</td></tr></table></section></section><blockquote>Said</blockquote></article>", f"{T3}\n1\n2\nSaid"),
        (f"<article>{P3}<div><article class='comment'><p>I, a reader, say, that</p></article></div></article>", T3),
        (f"<article class='has-comments post'><div id='no-cookies'>{P3}</div></article>", T3),
    ],
)
def test_html_whole_articles(page, want):
    """Written by hand: nothing of an article is lost, however short."""
    for before, behind in (("", ""), ("<body><nav><a href=x>menu</a></nav>", "<footer><p>end, of, the, page</footer>")):
        assert main_text(before + page + behind) == want


@pytest.mark.parametrize(
    "name", ["reader-comments", "user-comments", "article-comments", "js-comments", "disqus_thread", "commentsSection", "comments-v2-thing", "responses", "share-buttons", "related-articles", "privacy-notice", "cookieNotice", "cookieconsent", "article-footer", "tag-list"]
)
def test_html_boilerplate_within(name):
    """Comments and notices go, by class or id, wherever they lie in the article."""
    odd = "<p>Not, of, the, article, though, it, has, many, commas, and, is, long, enough</p>" * 3
    for attr in ("class", "id"):
        assert main_text(f"<article>{P3}<div {attr}='{name}'>{odd}</div></article>") == T3
        assert main_text(f"<body><div><div>{P3}</div><section {attr}='x {name}'>{odd}</section></div>" if attr == "class" else f"<body><div>{P3}<section id='{name}'>{odd}</section></div>") == T3


def test_html_documents(spark):
    """The pages of the test tables give the text of the documents they show, word for word."""
    d = "/root/testdata/sf0.01"
    shown = spark.read.parquet(f"{d}/pages.parquet").selectExpr("page_id", "url", "html", "try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]+/([0-9]+)', 1) as long) as doc_id")
    rows = extract_text(shown).join(shown.select("page_id", "doc_id"), "page_id").join(spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text as want"), "doc_id").collect()
    same = [x.text.split()[-len(w) :] == w or set(w) <= set(x.text.split()) for x in rows if (w := (x.want or "").split())]
    assert len(same) > 200 and sum(same) >= 0.95 * len(same)
    assert extract_text(shown.limit(0)).count() == 0


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>hi there"), (1, "u", "<p>hi there"), (None, None, None)], "page_id long, url string, html string")
    assert [(r.page_id, r.text, r.n_chars) for r in extract_text(pages).collect()] == [(1, "hi there", 8)] * 2 + [(None, "", 0)]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").limit(3000), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in got)
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    ranks = s.argsort().argsort()
    assert (ranks[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum()) > 0.85


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity(frame(spark, [None, "a"], [None, 1]), labels).collect()
    assert [(r.doc_id, r.predicted) for r in got] == [(None, 0), (1, 0)]


def test_toxicity_learns(spark):
    """Both dictionaries are trained; insults in new contexts are caught, ordinary text is left alone; columns may clash, rows may repeat."""
    r = random.Random(12)
    vocab, insults = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(900)}" for _ in range(900)], ["idiotic", "scumbag", "moronic", "worthless", "pathetic"]
    texts = []
    for i in range(600):
        w = [r.choice(vocab) for _ in range(r.randint(30, 120))]
        for _ in range(6 * (i % 4 == 0)):
            w.insert(r.randrange(len(w)), r.choice(insults))
        texts.append(" ".join(w))
    texts += [None, "", texts[0], "ordinary " * 30_000 + "scumbag moronic " * 300]
    docs = frame(spark, texts).withColumnRenamed("lang", "toxic").withColumnRenamed("source", "score")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(0, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity(docs, labels).collect()}
    fresh = [x for i, x in got.items() if x.held_out and i < 600]
    assert len(fresh) > 100 and sum(x.predicted == (x.doc_id % 4 == 0) for x in fresh) >= 0.97 * len(fresh)
    assert got[600].predicted == got[601].predicted == 0 and got[602].score == got[0].score and got[603].predicted == 1 and got[603].n_windows > 2500
    assert toxicity(docs.limit(0), labels).count() == 0


def test_decontamination(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    items = [[r.choice(vocab) for _ in range(30)] for _ in range(5)]
    plain = [" ".join(r.choice(vocab) for _ in range(200)) for _ in range(30)]
    edited = list(items[1])
    for k in range(4, 30, 6):
        edited[k] = "other"
    texts = [*plain, plain[0] + " " + " ".join(items[0]).upper() + "! " + plain[1], plain[2] + " " + " ".join(edited[:12] + edited[13:]), None, ""]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.score, x.start_word) for x in contaminated(frame(spark, texts), bench).collect()}
    assert set(got) == {(30, 0), (31, 1)} and got[30, 0] == (1.0, 200)
    assert decontaminate(frame(spark, texts), bench).count() == len(texts) - 2


def test_decontamination_large_group(spark):
    """Copies with one and the same edit are found however many they are, beside one whole copy."""
    r = random.Random(6)
    item = [f"i{k}" for k in range(30)]
    edited = [*item[:14], "other", *item[15:]]
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(50)) + " " + " ".join(w) for w in [item, *[edited] * 12]]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert {x.doc_id for x in contaminated(frame(spark, texts), bench).collect()} == set(range(13))


def test_decontamination_brute_force(spark):
    """Whatever the rate and kind of edits, found is what a whole alignment finds, also where no four words are intact."""
    r = random.Random(7)
    vocab = [f"w{k}" for k in range(150)]
    items = [[r.choice(vocab) for _ in range(n)] for n in (4, 7, 15, 15, 16, 30, 41)]
    texts = []
    for rate in (0.1, 0.2, 0.25, 0.33, 0.4, 0.5, 0.6):
        for w in items:
            for kind in "sid":
                copy = [y for k, x in enumerate(w) for y in (([r.choice(vocab)] if kind == "s" else [x, r.choice(vocab)] if kind == "i" else []) if r.random() < rate else [x])]
                texts.append([r.choice(vocab) for _ in range(r.randrange(80))] + copy + [r.choice(vocab) for _ in range(r.randrange(80))])
    texts += [["q"] * 9 + [x if k % 4 else "q" for k, x in enumerate(items[5])], [y for x in items[3] for y in (x, "q")]]
    want = {(d, i): align(t, w)[0] / (2 * len(w)) for d, t in enumerate(texts) for i, w in enumerate(items) if align(t, w)[0] >= len(w)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(x.doc_id, x.item_id): x.score for x in contaminated(frame(spark, [" ".join(t) for t in texts]), bench).collect()} == want
    assert {(len(texts) - 2, 5), (len(texts) - 1, 3)} <= set(want) and len(want) > 80


def test_alignment():
    def slow(p, q):
        h = [[0] * (len(p) + 1) for _ in range(len(q) + 1)]
        for i in range(len(q)):
            for j in range(len(p)):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if p[j] == q[i] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        return max(max(x) for x in h)

    r = random.Random(2)
    for _ in range(200):
        p, q = ([r.choice("abcd") for _ in range(r.randint(1, 20))] for _ in "ab")
        assert align(p, q)[0] == slow(p, q)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [None, "", "a b c " * 900, "it's <|endoftext|> é  \n x", *[f"word{i} " * (i % 90) for i in range(200)]]
    got = pack_documents(frame(spark, texts)).collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seqs = collections.defaultdict(list)
    for p in got:
        seqs[p.sequence_id].append(p)
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted((p for p in got if p.doc_id == i), key=lambda p: p.start)
        assert sum(p.length for p in mine) == len(ids) and all(p.doc_tokens == len(ids) for p in mine)
        at = 0
        for p in mine:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at & (at - 1) == 0 and at <= 1024


def test_pack_balance():
    pieces, n = pack_group([700, 600, 500, 400, 300, 300, 200, 72], 1024)
    assert n == 3 and sum(p[2] for p in pieces) == 3072


def test_quality_counts(spark):
    r = random.Random(8)
    texts = [None, "", " \n ", "a" * 50, "x y " * 60, *[" ".join(r.choice("abc") for _ in range(r.randint(1, 60))) for _ in range(40)], "l1 l1\n \nl1 l1\n#x <y>\nq"]
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for row in quality_rules(frame(spark, texts), labels).collect():
        t = texts[row.doc_id] or ""
        w = t.split()
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = len({k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)})
        ls = [x for x in t.split("\n") if x.strip()]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), rep)
        assert row.base_failed == (len(w) < 20 or 100 * rep > 30 * len(w)) and (not row.kept or not row.base_failed) and row.sig == "clash"


def test_quality_verdict(spark):
    good, odd = [f"{' '.join(f'g{(i * k) % 50}' for k in range(40))}" for i in range(1, 30)], [" ".join(f"q{(i + k) % 40}" for k in range(30)) for i in range(12)]
    labels = spark.createDataFrame([(i, int(i < 29), 0) for i in range(41)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules(frame(spark, good + odd), labels).where("kept or base_failed").collect()}
    assert kept >= set(range(29)) and not kept & set(range(29, 41))
    assert quality_rules(frame(spark, []), labels).count() == 0


def test_quality_size(spark):
    """Bad documents stay rejected when n-grams are many more than the least number of buckets; `slots` changes no score."""
    r = random.Random(3)
    good = [" ".join(f"g{r.randrange(400)}" for _ in range(60)) for _ in range(150)]
    bad = [" ".join(f"b{r.randrange(100_000)}" for _ in range(60)) for _ in range(60)]
    texts = [*good, *bad, bad[0]]
    ids = [*range(210), 150]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(180)], "doc_id long, quality int, toxic int")
    scores = [sorted((x.doc_id, round(x.llr, 9), x.kept) for x in quality_rules(frame(spark, texts, ids), labels, n_buckets=64, slots=k).collect()) for k in (16, 1 << 16)]
    assert scores[0] == scores[1] and len(scores[0]) == 211
    assert all(kept == (i < 150) for i, _, kept in scores[0])


def test_quality_plan(spark):
    """The frequent buckets are a table: no list of them is part of the plan; there are about as many as asked for."""
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_rules(frame(spark, [f"a b c{i % 7} d" * 9 for i in range(40)]), labels)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    before = spark.conf.get(FREE)
    rows = spark.range(1000).selectExpr("id % floor(1 + sqrt(id)) bucket")
    counts = collections.Counter(r.bucket for r in rows.collect())
    for slots in (0, 5, 1 << 20):
        got = {r.bucket for r in frequent(Scratch(spark, "frequent"), rows, slots).collect()}
        assert len(got) <= slots + 5 and (slots < len(counts) or got == {b for b, n in counts.items() if n > 1})
    assert spark.conf.get(FREE) == before


def test_quality_llr(spark):
    """llr and verdict against counts made word by word, with buckets enough that no two n-grams share one."""
    import math

    r = random.Random(11)
    texts = [" ".join(f"t{int(r.paretovariate(0.6)) % 300}" for _ in range(r.randint(0, 70))) for _ in range(60)]
    texts += [texts[0], None, "", *["x" + t.replace("t", "u") for t in texts[:8]]]
    ids = [*range(len(texts) - 1), None]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(50)] + [(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    alpha, size = 1.0, 1 << 22
    each = [[(x,) for x in w] + list(zip(w, w[1:])) for w in [(t or "").split() for t in texts]]
    raw, aim = collections.Counter(g for e in each for g in e), collections.Counter(g for i, e in zip(ids, each) if i is not None and i < 50 and i % 3 == 0 for g in e)
    n, m = sum(raw.values()), sum(aim.values())
    ratio = {g: math.log((aim[g] + alpha) / (m + alpha * size)) - math.log((raw[g] + alpha) / (n + alpha * size)) for g in raw}
    want = sorted((-1 if i is None else i, round(sum(map(ratio.get, e)) / len(e), 3) if e else 0.0) for i, e in zip(ids, each))
    docs = frame(spark, texts, ids).withColumnRenamed("lang", "w").withColumnRenamed("source", "key")
    found = quality_rules(docs, labels, n_buckets=size, slots=64)
    assert found.columns[:6] == ["doc_id", "text", "w", "key", "n_chars", "sig"]
    rows = found.collect()
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.llr) for x in rows)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a[1] - b[1]) < 2e-3 for a, b in zip(got, want))
    assert all(x.kept == (not x.base_failed and x.llr >= -0.25) for x in rows) and {x.key for x in rows} == {"s"}


def test_sharding(spark):
    texts = ["x" * (i * 37 % 900) for i in range(500)]
    got = shard(frame(spark, [*texts, None]), max_bytes=4000, start_bits=4).collect()
    size, depth = collections.Counter(), {}
    for r in got:
        size[r.shard] += r.n_bytes
        assert len(r.shard) == r.depth
    assert len(got) == 501 and max(size.values()) <= 4000
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard contains another
    for s in names:  # each split was needed
        assert sum(n for k, n in size.items() if k.startswith(s[:-1])) > 4000
    assert sorted(map(tuple, shard(frame(spark, [*texts, None]), max_bytes=4000).collect())) == sorted(map(tuple, got))  # wherever the directory starts
    assert sorted(map(tuple, shard(frame(spark, [*texts, None]), max_bytes=4000, start_bits=1, step=1).collect())) == sorted(map(tuple, got))
    same = shard(frame(spark, ["y" * 100] * 9, [1] * 9), max_bytes=300)
    assert same.select("shard").distinct().count() == 1
    odd = shard(frame(spark, ["z" * 400, "z" * 400, "", None], [None, None, 2, 3]), max_bytes=300).collect()
    assert sorted(r.n_bytes for r in odd) == [0, 0, 400, 400] and len({r.shard for r in odd if r.doc_id is None}) == 1
    assert shard(frame(spark, []), max_bytes=300).count() == 0


def test_chat(spark):
    r = random.Random(4)
    texts = ["</s>[INST] ok [/INST]", "\\l<s>]\n[x\\", "", None, "é" * 40, "long " * 700, "short one"]
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], r.choice(texts)) for c in range(12) for t in range(r.randint(1, 40))]
    rows += [(None, 0, None, "x"), (50, None, "assistant", "tie"), (50, None, "assistant", "tie")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = format_chat(table, span=8)
    import hashlib

    for x in read_back(windows).collect():
        mine = sorted(((-1 if t is None else t, o or "", s or "") for c, t, o, s in rows if c == x.conv_id))
        loss = "".join(s for _, o, s in mine if o == "assistant")
        assert x.n_turns == len(mine) and x.turns_sha256 == hashlib.sha256("".join(f"{o}\n{s}\n" for _, o, s in mine).encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # Only a long turn, alone but for the system turn, or a long system turn takes a window beyond the budget.
    leads = {c for c, t, o, _ in rows if t == 0 and o == "system"}
    assert all(w.over_budget == (w.tokens > 1024) and (w.tokens <= 1024 or w.n_fresh <= 1 + (w.window_id == 1 and w.conv_id in leads)) for w in windows.collect())
    assert windows.where("n_context > 0").count() > 0


@pytest.mark.parametrize("size", [2_000, 8_000])
def test_chat_system_turn_in_every_window(spark, size):
    """However long it is; it takes from the room of the others, and windows that it takes beyond the budget say so."""
    rows = [(1, 0, "system", "s" * size)] + [(1, t, ("user", "assistant")[t % 2], f"turn {t} " + "w" * 280) for t in range(1, 30)]
    windows = format_chat(spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, lead string, half int"))
    got = sorted(windows.collect(), key=lambda w: w.window_id)
    assert len(got) > 5 and all(w.formatted.startswith("<s>[system]\n" + "s" * size) for w in got)
    assert {w.over_budget for w in got} == {size == 8_000} and read_back(windows).first().n_turns == 30


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert format_chat(spark.createDataFrame([], schema)).count() == 0
    alone = format_chat(spark.createDataFrame([(None, None, "system", None)], schema)).collect()
    assert [(w.conv_id, w.n_context, w.n_fresh, w.loss_spans) for w in alone] == [(None, 0, 1, [])]


def test_urls(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/")]
    urls = ["https://A.Example.ORG/es/1?x#y", "http://example.org", "https://x.com/fr/2", "https://bad.net/1", None, "nothing", "http://notorg/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(100 + i, "http://bad.net/z", "") for i in range(30)], "page_id long, url string, n string")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(1, 0), (2, 0)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, outcomes, rules).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "", None, "allow")
    assert got[2] == ("x.com", "/fr/2", "com/fr/", "allow") and got[3] == ("bad.net", "/1", None, "block")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6][2] is None and len(got) == 37


def test_url_hierarchy(spark):
    """New hosts of a bad domain are blocked, those of other domains are not; a host that is good alone stays."""
    r = random.Random(9)
    rows = [("bad.net", 1)] * 200 + [(f"h{i}.bad.net", 1) for i in range(3)] + [(f"www.{c}.net", int(r.random() < 0.1)) for c in "abcdefgh" for _ in range(20)] + [("x.org.uk", 0)]
    urls = [f"http://{h}/{i}" for i, (h, _) in enumerate(rows)] + ["http://new.bad.net/", "http://new.a.net:80/", "http://other.net/", "http://else.zz/", "http:///x"]
    pages = spark.createDataFrame([*enumerate(urls), (None, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id long, bad int")
    got = {x.host: (x.verdict, x.bad_mean, x.bad_bound) for x in filter_urls(pages, outcomes, []).collect()}
    assert got["bad.net"][0] == got["new.bad.net"][0] == got["h0.bad.net"][0] == "block"
    assert {got[h][0] for h in ("new.a.net:80", "other.net", "else.zz", "www.a.net", "x.org.uk", "")} == {"allow"}
    assert got[""] == ("allow", None, None) and filter_urls(pages.limit(0), outcomes, []).count() == 0
    assert {x.verdict for x in filter_urls(pages, outcomes.limit(0), []).collect()} == {"allow"}


def test_url_strength(spark):
    """The likelihood against one from factorials: products over the draws one by one."""
    import math

    from folio_spark.llm.urls import STRENGTHS, best_strength

    r = random.Random(1)
    for spread in (0.5, 8.0, 200.0):
        units = []
        for _ in range(60):
            p, n = r.betavariate(spread * 0.3, spread * 0.7), r.randint(1, 40)
            units.append((float(n), float(sum(r.random() < p for _ in range(n))), 0.3))
        slow = lambda s: sum(sum(math.log((s * p + i)) for i in range(int(k))) + sum(math.log(s * (1 - p) + i) for i in range(int(n - k))) - sum(math.log(s + i) for i in range(int(n))) for n, k, p in units)  # noqa: B023, E731
        assert best_strength(spark.createDataFrame(units, "n double, k double, prior double")) == max(STRENGTHS, key=slow)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 0 and set(r.doc_id for r in out.select("doc_id").collect()) <= set(r.doc_id for r in docs.collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).schema.names == docs.columns
