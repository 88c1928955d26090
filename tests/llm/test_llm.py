"""The training-data operators on small tables: brute force, round trips, held-out accuracy, and odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import decontaminate, html_extract, licenses, near_dedup, packing, pii, quality_classifier, quality_rules, queries, records, samples, tokens, url_filter
from plinth.llm.common import materialise, span_hashes, text_slices, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, host string"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " ", "\n\n", "x", "é", "one two", "a\tb\x0bc\n", "the same line\nthe same line\nthe same line\n" * 3, "long " * 30_000, "1" * 50_000, "@" * 300 + ".", "🙂 " * 5]


def table(spark, texts, ids=None):
    """A documents table with further columns whose names clash with what operators add."""
    rows = [((i if ids is None else ids[i]), t, "en", None, None if t is None else len(t), 0.5, "mine", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    syllables = "an the er in on re st ea or ti ing ed th sh wh nd ou ly".split()
    make = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    return lambda n: " ".join(make() for _ in range(n))


# --- shared ----------------------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    texts = [t or "" for t in ODD]
    batch = pa.record_batch({"text": pa.array(ODD, pa.string())})
    got = []
    for rows, data, offs in text_slices(batch, most=64):
        w = words(data, offs)
        raw = data.tobytes()
        got += [[raw[a:b].decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t) for t in texts]


def test_equal_words_hash_alike_wherever_they_are():
    data = np.frombuffer(b"ab xx ab AB abab", np.uint8)
    w = words(data, np.array([0, len(data)]))
    h = span_hashes(data, w.start, w.end)
    low = span_hashes(data, w.start, w.end, lower=True)
    assert h[0] == h[2] != h[3] and low[0] == low[3] and len(set(h.tolist())) == 4


def test_long_slices_hash_like_short_ones(monkeypatch):
    from plinth.llm import common

    rng = random.Random(2)
    parts = ["x" * rng.randint(1, 400) if rng.random() < 0.05 else "".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    data = np.frombuffer(" ".join(parts).encode(), np.uint8)
    w = words(data, np.array([0, len(data)]))
    want = span_hashes(data, w.start, w.end)
    monkeypatch.setattr(common, "SLICE_BYTES", 256)
    common._powers.clear()
    assert (span_hashes(data, w.start, w.end) == want).all()
    common._powers.clear()


# --- 1 and 9: quality ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def graded(spark, prose):
    good = [prose(120) + "." for _ in range(160)]
    bad = [" ".join(w.upper() + "!!" for w in prose(120).split()) for _ in range(160)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 160), 0) for i in range(320)] + [(0, None, 0), (None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_op1_held_out_accuracy(graded):
    docs, labels = graded
    model = quality_classifier.fit_on(docs, labels)
    out = quality_classifier.score(docs, model).select("doc_id", samples.held_out(F.col("doc_id")).alias("held"), "score").toPandas()
    assert len(out) == 320 and out.score.between(0, 1).all()
    assert [bool(h) for h in out.held] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]
    held = out[out.held]
    assert ((held.score >= 0.3) == (held.doc_id < 160)).mean() > 0.95


def test_op1_odd_input(spark, graded):
    model = quality_classifier.fit_on(*graded)
    out = quality_classifier.score(table(spark, ODD + ["dup", "dup"], [None] + [7] * (len(ODD) + 1)), model)
    assert out.count() == len(ODD) + 2 and out.where("score is null or score < 0 or score > 1").isEmpty()
    empties = {r["score"] for r in out.where("text is null or text = ''").collect()}
    assert len(empties) == 1
    assert quality_classifier.score(table(spark, []), model).isEmpty()
    clash = table(spark, ["a b c"] * 3).withColumnsRenamed({"lang": "_quality_score", "source": "_QUALITY_SCORE1"})
    assert quality_classifier.accept.__doc__ and quality_classifier.score(clash, model, column="score").columns[:2] == ["doc_id", "text"]
    nothing = quality_classifier.fit_on(table(spark, ["a"]), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_classifier.score(table(spark, ["a"]), nothing).first()["score"] == 0.5


def test_scores_do_not_move_with_the_share_that_is_sampled(graded):
    """Fitted on all of 20:1 labels, or on a sample that evens them out, a text has nearly the same odds."""
    docs, labels = graded
    for keep in (20, 2):
        few = labels.where(f"doc_id is not null and quality is not null and (quality = 1 or doc_id % {keep} = 0) and not (doc_id = 1 and quality = 0)")
        whole, even = (samples.labelled_sample(docs, few, per_class=n) for n in (1000, 40))
        assert whole.share == even.share and abs(whole.share - whole.rows.y.mean()) < 1e-9
        y = np.array([1] * 40 + [0] * 20)
        assert abs(samples.shift(y) - math.log(0.5)) < 1e-9
        a, b = (quality_rules.fit(x) for x in (whole, even))
        texts = [r["text"] for r in docs.where("doc_id < 20").collect()]
        scores = [quality_rules.judge(docs.where("doc_id < 20"), m).agg(F.avg("probability")).first()[0] for m in (a, b)]
        assert len(texts) == 20 and abs(scores[0] - scores[1]) < 0.15, (keep, scores)


def test_long_labelled_texts_take_part(spark, prose):
    long = " ".join([prose(2000)] * 12)
    assert len(long) > samples.WINDOWS * samples.WINDOW
    docs = table(spark, [long, "short"], [1, 2])
    got = samples.labelled_sample(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).rows
    if len(got) == 2:
        text = got.text[0]
        assert len(text) == samples.WINDOWS * samples.WINDOW and text[: samples.WINDOW] == long[: samples.WINDOW] and text[-samples.WINDOW :] == long[-samples.WINDOW :]


def brute_counts(t):
    w = WORD.findall(t)
    seen, grams, dup = set(), {}, 0
    for k in range(len(w) - 2):
        grams.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(3)}
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_op9_counts_and_verdict(spark, graded):
    docs, labels = graded
    model = quality_rules.fit(samples.labelled_sample(docs, labels))
    texts = [*ODD, "a b a b a b a b", "# x\n# x\n x\n# x", "p q r\np q r"]
    out = {r["doc_id"]: r for r in quality_rules.judge(table(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t or ""), t[:40] if t else t
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = quality_rules.judge(docs, model).select("doc_id", "kept", samples.held_out(F.col("doc_id")).alias("held")).where("held").toPandas()
    assert (kept.kept == (kept.doc_id < 160)).mean() > 0.95


def test_op9_without_labels_leaves_it_to_the_rules(spark, prose):
    model = quality_rules.fit(samples.labelled_sample(table(spark, []), spark.createDataFrame([], "doc_id long, quality int")))
    assert [r["kept"] for r in quality_rules.judge(table(spark, [prose(80), "few words"]), model).orderBy("doc_id").collect()] == [True, False]


# --- 2: personal data ------------------------------------------------------------------------------------------

_REF = (
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def reference_spans(t):
    return [(k, *m.span()) for k, (p, ok) in enumerate(_REF) for m in p.finditer(t) if ok(m.group())]


def test_base_patterns_match_their_definition():
    rng = random.Random(5)
    for _ in range(6000):
        t = "".join(rng.choice("a.@-+1203 ()é%\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == reference_spans(t), repr(t)


def test_crf_adds_what_patterns_miss():
    texts = ['x token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" y', "call (212) 555-0187 or 212-555-0187 now", "in 1999 v2.0. of 3.14 at 12:30 on 2024-01-02 cost 4000"]
    batch = pa.record_batch({"text": texts})
    (_, data, offs), *_ = text_slices(batch)
    found = [[(pii.KINDS[k], t[a:b]) for k, a, b in every] for t, (_, every) in zip(texts, pii.find_spans(texts, data, offs, pii.train()))]
    assert found == [[("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b")], [("phone", "(212) 555-0187"), ("phone", "212-555-0187")], []]


def test_viterbi_is_the_best_path():
    crf, rng = pii.train(), np.random.default_rng(1)
    runs = [rng.normal(size=(n, len(pii.LABELS))) * 3 for n in (1, 2, 3) for _ in range(4)]
    heads, tails = np.array([False, True, False, True] * 3), np.array([False, False, True, True] * 3)
    from itertools import product

    for run, got, head, tail in zip(runs, crf.viterbi(runs, heads, tails), heads, tails):
        ends = lambda p: (crf.starts[p[0]] if head else crf.moves[0, p[0]]) + (0 if tail else crf.moves[p[-1], 0])
        score = lambda p: sum(run[i, x] for i, x in enumerate(p)) + sum(crf.moves[a, b] for a, b in zip(p, p[1:])) + ends(p)
        best = max(product(range(len(pii.LABELS)), repeat=len(run)), key=score)
        assert tuple(got) == best


def test_crf_decodes_every_word_of_a_text(prose):
    """The numpy scores are those of the features, and the words left out as surely O are O on the best path of the whole text."""
    crf, rng = pii.train(), random.Random(7)
    parts = ["token", "Élan", "×y", "“z”", "deadbeefdeadbeefdead", "(card)", "4111", "1111", "+1", "555-0187", "é", "²³", "12.", "a1@b2.c", "tel", "=", "K!!", "10.0.0.1", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.5 else prose(1) for _ in range(rng.randint(1, 60))) for _ in range(40)] + [""]
    data, offs = utf8(texts)
    w = words(data, offs)
    rows = crf.rows(data, w)
    unsure, _ = crf.open_words(rows, w.first)
    own, before, further = crf.tables
    for d, text in enumerate(texts[:-1]):
        ws, k = text.split(" "), int(w.first[d])
        scores = np.array([crf.weights[[crf.index[f] for f in pii.features(x, ws[i - 1] if i else "", ws[i - 2] if i > 1 else "") if f in crf.index]].sum(axis=0) for i, x in enumerate(ws)])
        fast = np.array([own[rows[k + i]] + before[rows[k + i - 1 if i else -1]] + further[rows[k + i - 2 if i > 1 else -1]] for i in range(len(ws))])
        assert np.allclose(scores, fast)
        labels = crf.viterbi([scores], np.array([True]), np.array([True]))[0]
        assert set((np.flatnonzero(labels) + k).tolist()) <= set(unsure.tolist())


def test_many_added_spans_take_linear_time():
    import time

    text = "call 212-555-0187 or " * 20_000
    data, offs = utf8([text])
    began = time.perf_counter()
    ((base, every),) = pii.find_spans([text], data, offs, pii.train())
    assert not base and len(every) == 20_000 and time.perf_counter() - began < 20


def test_op2_rows_and_redaction(spark):
    texts = [*ODD, "é mail me: jo.x@ex-a.org, +1 (017) 555-7713 ok 10.0.0.1, 4111 1111 1111 1111."]
    out = {r["doc_id"]: r for r in pii.find(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = sorted(reference_spans(t or "")) if t is None or len(t) < 1000 else sorted(pii.base_spans(t))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert out[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(out[i]["spans"].split(","))
    last = out[len(ODD)]
    assert (last["n_email"], last["n_ip"], last["n_card"], last["n_phone"]) == (1, 1, 1, 1)
    docs = table(spark, texts)
    clean = {r["doc_id"]: r for r in pii.clean(spark, docs, "").collect()}
    assert clean[len(ODD)]["text"] == "é mail me: [EMAIL], [PHONE] ok [IP], [CARD]."
    assert clean[len(ODD)]["n_chars"] == len(clean[len(ODD)]["text"])
    assert clean[0]["text"] is None and clean[9]["text"] == ODD[9] and len(clean) == len(texts)
    assert pii.find(table(spark, [])).isEmpty()


# --- 3: pages --------------------------------------------------------------------------------------------------


def test_op3_marked_article():
    page = html_extract.Page('<title>t</title><header>Top</header><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p>One<br>two <b>th</b>ree<p>Four\n five<div class="comments"><p>c</div><aside>s</aside><form>f</form><script>var t="</p>";</script></article><footer>&copy; x')
    assert page.article == ["A & B", "One two three", "Four five"] and page.marked


def test_op3_repeated_runs_go_and_unique_runs_stay(spark):
    notice = "subscribe to our letter and read much more of this every day"
    rows = [(i, f"http://a.org/{i}", f"<body><div>{notice}</div><p>page {i} has words {i * 7} of its own {notice} end {i}</p>") for i in range(4)]
    rows += [(20, "http://b.org/1", f"<div>{notice}</div>"), (21, None, None), (22, "u", ""), (23, "http://c.org/1", "<article><p>kept")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    # the longest repeat takes in the words around the notice that all pages share
    assert got == {0: "page 0 has words 0 0", 1: "page 1 has words 7 1", 2: "page 2 has words 14 2", 3: "page 3 has words 21 3", 20: notice, 21: "", 22: "", 23: "kept"}
    assert html_extract.extract(pages.limit(0)).isEmpty()


def test_op3_names_never_hide_an_article():
    page = html_extract.Page('<article class="post social-post share"><p>one</p><div class="news-alert side"><p>two</p></div><div class="comment-list"><p>c</p></div><div id=ad-box>a</div><p class="sharing-economy">three</article>')
    assert page.article == ["one", "two", "three"] and page.chrome == ["c", "a"]
    assert html_extract.Page("<main class=sidebar>x<nav>n</nav></main>").article == ["x"]


@pytest.mark.parametrize("source, text", [
    ("<article>a < b & c &lt;p&gt; <", "a < b & c <p> <"), ("<article>a<!-- x", "a"), ("<article>a<script>x", "a"), ("<article>a<p title='x>y", "a"),
    ("<article>a<svg><p>x</p>", "a x"), ("<article>a</nope></ >b<?x?>c<![CDATA[d]]>e", "abce"), ("</article>a<article>b</article></article>", "b"), ("<ARTICLE>a<P>b<BR/>c", "a\nb c"), ('<article data-x="a>b">c', "c"),
])
def test_op3_malformed_markup(source, text):
    page = html_extract.Page(source)
    assert "\n".join(page.article).replace("\n", " ") == text.replace("\n", " ")


def test_op3_hostile_markup_takes_linear_time():
    import time

    for unit in ("<div x=", "<script ", "<", "<!--", "<a b='", '<p class="', "</div", "<div>", "</div>", "<svg>", "<select>", "&amp", "<article><p>x</article>", "=\"'", "<![CDATA["):
        began = time.perf_counter()
        html_extract.Page(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - began < 5, unit


def test_op3_against_brute_force(spark):
    rng = random.Random(9)
    shared = [" ".join(f"s{k}w{j}" for j in range(rng.randint(7, 12))) for k in range(6)]
    rows, parts = [], []
    for i in range(40):
        def some(n):
            return [rng.choice(shared[: 1 + i % 6]) if rng.random() < 0.7 else " ".join(f"p{i}x{rng.randint(0, 99)}" for _ in range(rng.randint(1, 9))) for _ in range(n)]

        marked, host = rng.random() < 0.5, f"h{i % 4}.org"
        own, chrome = some(rng.randint(0, 4)), some(rng.randint(0, 2))
        inner = "".join(f"<p>{b}</p>" for b in own)
        rows.append((i, f"http://{host}/{i}", "".join(f"<nav>{b}</nav>" for b in chrome) + (f"<article>{inner}</article>" if marked else inner)))
        parts.append((host, marked, own, chrome))
    grams = lambda blocks: [tuple(t[k : k + html_extract.RUN]) for t in [" ".join(blocks).split()] for k in range(len(t) - html_extract.RUN + 1)]
    want = {}
    for i, (host, marked, own, _) in enumerate(parts):
        outside = {j: {*grams(c), *([] if m else grams(o))} for j, (h, m, o, c) in enumerate(parts) if h == host}
        known = {g for j in outside if j != i for g in outside[j]}
        shown = lambda g: sum(g in found for found in outside.values())
        known = {g for g in known if shown(g) >= html_extract.SHOWN and 2 * shown(g) >= len(outside)}
        hit = {k + n for k, g in enumerate(grams(own)) if g in known for n in range(html_extract.RUN)}
        at, kept = 0, []
        for b in own:
            words_ = b.split()
            runs, k = [], 0
            flags = [at + n in hit for n in range(len(words_))]
            at += len(words_)
            while k < len(words_):
                end = k
                while end < len(words_) and flags[end] == flags[k]:
                    end += 1
                if not flags[k] or (end - k < html_extract.RUN and end - k < len(words_)):
                    runs += words_[k:end]
                k = end
            kept += [" ".join(runs)] if runs else []
        want[i] = "\n".join(kept)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = html_extract.extract(pages.unionAll(pages.where("page_id = 3"))).collect()
    assert {r["page_id"]: r["text"] for r in out} == want and len(out) == 41
    assert all(r["n_chars"] == len(r["text"]) for r in out) and any(r["boilerplate_tokens"] for r in out)


def test_op3_pages_that_mark_no_article(spark, tiny):
    """With all marks taken off, pages of one host quote each other's prose, which stays; a template's text, which nothing names, goes."""
    path = tiny.replace("0.001", "0.01")
    pages = spark.read.parquet(f"{path}/pages.parquet")
    want = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    template = "every page of this site says that its words are worth reading twice"
    plain = F.regexp_replace("html", r"<(/?)(article|main)\b", "<$1div")
    bare = html_extract.extract(pages.withColumn("html", plain)).collect()
    dressed = html_extract.extract(pages.withColumn("html", F.regexp_replace(plain, r"(<body[^>]*>)", f"$1<div class='x9'>{template}</div>"))).collect()
    sizes = {r["host"]: r["n"] for r in pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.count_distinct("page_id").alias("n")).collect()}
    host = {r["page_id"]: r["host"] for r in pages.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).collect()}
    for rows, extra in ((bare, ""), (dressed, template)):
        right = found = all_ = left = 0
        for r in rows:
            gold = want[r["page_id"]].split()
            got = r["text"].split()
            if extra and sizes[host[r["page_id"]]] < html_extract.SHOWN:
                got = r["text"].removeprefix(extra).split()  # a host of one or two pages repeats nothing
            left += extra != "" and sizes[host[r["page_id"]]] >= html_extract.SHOWN and extra in r["text"]
            common = sum((Counter(gold) & Counter(got)).values())
            right, found, all_ = right + common, found + len(got), all_ + len(gold)
        assert right / found > 0.999 and right / all_ > 0.999 and left == 0, (right, found, all_, left)


def test_suffix_ranks_equal_where_runs_equal():
    rng = np.random.default_rng(2)
    tokens_ = rng.integers(0, 3, 400).astype(np.uint64)
    ranks = html_extract.suffix_ranks(tokens_)
    runs = [tuple(tokens_[i : i + html_extract.RUN]) for i in range(len(tokens_) - html_extract.RUN + 1)]
    assert len(ranks) == len(runs)
    assert len(set(zip(ranks.tolist(), runs))) == len(set(runs)) == len(set(ranks.tolist()))


# --- 4 and 10: tokens ------------------------------------------------------------------------------------------


SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<| x", "İstanbul İ. x"]


def stock(name):
    """The library's tokenizer as its file makes it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary(name))


def utf8(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(name, monkeypatch):
    rng = random.Random(4)
    enc, tok = tokens.Encoder(tokens.vocabulary(name)), stock(name)
    parts = [*" \n\tab1!é\x85\x1c\u00a0\u2009\u3000“—\u0301İßZ.,", "'s", "<|endoftext|>", "<|startoftext|>", "中文"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [t or "" for t in ODD] + SPECIAL
    want = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    data, offs = utf8(texts)
    for chunk in (tokens.CHUNK_BYTES, 50):  # long texts are cut at blanks, wherever the cuts are
        monkeypatch.setattr(tokens, "CHUNK_BYTES", chunk)
        ids, bounds = enc.encode(data, offs)
        assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:])] == want
    assert enc.encode(data[:0], np.zeros(1, np.int64))[0].size == 0


def test_the_table_of_pieces_may_fill_up(monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 64)
    enc, tok = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json")), stock("byte_bpe_50k.json")
    for k in range(4):
        texts = [" ".join(f"w{i % 97}x{k}" for i in range(300)), f"w{k}x0 w1x0"]
        ids, bounds = enc.encode(*utf8(texts))
        assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_supersteps_place_every_piece_once():
    rng = random.Random(6)
    counts = {rng.randint(1, 64): rng.randint(1, 90) for _ in range(40)}
    plan, fill = packing.supersteps(counts, 64), {}
    placed = {n: 0 for n in counts}
    for length, a, b, seq, off in plan.tolist():
        placed[length] += b - a
        for k in range(b - a):
            fill.setdefault(seq + k, []).append((off, length))
    assert placed == counts
    for parts in fill.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= 64
    assert len(fill) <= 1.05 * -(-sum(k * n for k, n in counts.items()) // 64) + 1


def test_op4_against_brute_force(spark, prose):
    texts = [*ODD, *SPECIAL, *[prose(n) for n in (3, 3, 3, 700, 5000)]]
    path = tokens.vocabulary("word_bpe_49k.json")
    out = packing.pack_documents(table(spark, texts, [*range(len(texts) - 1), 0]).repartition(3), path).toPandas()
    tok, want = stock("word_bpe_49k.json"), []
    for i, t in zip([*range(len(texts) - 1), 0], texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes())) for p in range(0, len(ids), 2048)]
    assert sorted(zip(out.doc_id, out.piece, out.start, out.length, out.ids_crc32)) == sorted(want)
    for _, rows in out.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() <= 2048
    assert packing.pack_documents(table(spark, []), path).isEmpty()


def test_op10_round_trip(spark, tmp_path, prose):
    texts = [*ODD, *SPECIAL, *[prose(n) for n in (3, 3, 900)]]
    ids = [*range(len(texts) - 2), 5, None]
    path, out = tokens.vocabulary("byte_bpe_50k.json"), f"{tmp_path}/out"
    index = records.starts(records.write(table(spark, texts, ids).repartition(3), out, path, 2))
    tok, at, want, seqs = stock("byte_bpe_50k.json"), 0, [], []
    ties = {r["text"]: r["h"] for r in table(spark, texts, ids).select("text", F.xxhash64("text").alias("h")).collect()}
    for i, t in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0, ties[x[1]])):
        s = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(s), zlib.crc32(s.tobytes())))
        seqs.append((i, s.tolist()))
        at += len(s)
    got = index.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    everything = sorted(((r["doc_id"], r["ids"]) for r in records.read(spark, out).collect()), key=str)
    assert everything == sorted(seqs, key=str)
    some = index.where("doc_id in (4, 9)")
    assert sorted(r["doc_id"] for r in records.read(spark, out, some).collect()) == [4, 9]


def test_damage_is_noticed():
    f = records.frame(3, np.arange(9, dtype="<u4"), False) + b"\n"
    assert records.parse(f)[0] == 3 and records.parse(f)[1].tolist() == list(range(9)) and records.parse(f)[2] == len(f)
    for at in (2, 9, 20, len(f) - 3):
        broken = bytearray(f)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.parse(bytes(broken))
    with pytest.raises(ValueError):
        records.parse(f[:-6])


# --- 5: near-duplicates ----------------------------------------------------------------------------------------


def brute_components(ids, texts, size, similarity=80):
    sets = {}
    for i, t in zip(ids, texts):
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    of = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = of[a], of[b]
                of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
    return {i: (len(sets[i]), of[i]) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_op5_against_brute_force(spark, prose, size):
    rng, texts = random.Random(8), []
    for _ in range(8):
        base = prose(60).split()
        for _ in range(7):  # copies with more and more words changed, and exact ones
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = prose(1)
        texts.append(" ".join(base).upper())
    texts += [*ODD, "one two", "ONE two", "x", "X y"]
    ids = list(range(100, 100 + len(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.find(table(spark, texts, ids), size).collect()}
    assert got == brute_components(ids, texts, size)


def test_op5_odd_ids_and_the_stage(spark, prose):
    a, b = prose(50), prose(50)
    docs = table(spark, [a, a, a, b, None, a, b], [3, 1, 1, 2, 4, None, 9])
    found = near_dedup.find(docs, 5)
    assert found.count() == 7
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found.collect()} == {(3, 1, False), (1, 1, True), (2, 2, True), (4, 4, True), (None, None, True), (9, 2, False)}
    kept = near_dedup.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "None"]
    assert near_dedup.find(table(spark, []), 5).isEmpty()
    clash = docs.withColumnsRenamed({"lang": "_n", "source": "_id"})
    assert near_dedup.keep_one(spark, clash, "").columns == clash.columns


def test_op5_open_groups_against_brute_force(spark, prose, monkeypatch):
    """Texts around one common passage, chains of near copies, and leaders that settle little."""
    monkeypatch.setattr(near_dedup, "DRAWN", 1)
    rng, passage = random.Random(3), prose(60)
    texts = [f"{passage} {prose(rng.randint(4, 40))}" for _ in range(60)]
    for start in range(3):
        chain = prose(70).split()
        for _ in range(30):
            texts.append(" ".join(chain))
            chain[rng.randrange(len(chain))] = prose(1)
    ids = list(range(len(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.find(table(spark, texts, ids), 2).collect()}
    assert got == brute_components(ids, texts, 2)


def test_odd_sketches_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    for shared in (0.9, 0.8, 0.5):
        n = round(2000 * shared / (1 + shared))
        a, b = np.unique(pool[:1000]), np.unique(np.concatenate((pool[:n], pool[1000 : 2000 - n])))
        x, y = near_dedup.odd_sketches(near_dedup.minhashes([a, b]))
        bits = int(np.bitwise_count(x ^ y).sum())
        assert (bits <= near_dedup.most_bits()) == (shared >= 0.8)


# --- 6 and 7: native filters -----------------------------------------------------------------------------------


def test_op6_rules(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/x?y", "https://a.example.com/en/", "https://example.com/de/", "http://x.net/es/1#t", "http://x.net/es", "ftp://com/", "http://notexample.com", "http://example.com/en/a", "http://www.spam-farm.example.org/en/1", "http://a.org?x=/en/", "http://x.net/es/1#t"]
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    out = url_filter.filter_urls(pages, url_filter.default_listing(spark)).select("page_id", "host", "path", "rule", "verdict")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 4: ("a.example.com", "/en/", "example.com/en/", "block"),
        5: ("example.com", "/de/", "com/", "allow"), 6: ("x.net", "/es/1", "net/es/", "block"), 7: ("x.net", "/es", None, "allow"),
        8: ("com", "/", "com/", "allow"), 9: ("notexample.com", "", None, "allow"), 10: ("example.com", "/en/a", "example.com/en/", "block"),
        11: ("www.spam-farm.example.org", "/en/1", None, "block"), 12: ("a.org", "", None, "allow"), 13: ("x.net", "/es/1", "net/es/", "block"),
    }
    assert url_filter.filter_urls(pages.limit(0), url_filter.default_listing(spark)).isEmpty()
    none = url_filter.filter_urls(pages, url_filter.listing(spark, []))
    assert none.where("verdict <> 'allow' or rule is not null").isEmpty() and none.count() == len(urls)


def test_op6_clashing_names_and_ties(spark):
    pages = spark.createDataFrame([("http://a.b.c/xy/z", 1, "u", "v", "w")], "url string, page_id long, _url string, _verdict string, KEY string")
    listed = url_filter.listing(spark, [("a.b.c/", "allow", 0), ("b.c/xy", "block", 0), ("b.c/xy", "allow", 0)])
    row = url_filter.filter_urls(pages, listed).first()
    assert (row["rule"], row["verdict"], row["_url"], row["_verdict"], row["KEY"]) == ("b.c/xy", "allow", "u", "v", "w")


def test_op7_clashing_names(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "x", "y")], "doc_id long, text string, _found string, matched string")
    row = licenses.scan(docs).first()
    assert row["licences"] == "MIT" and row["_found"] == "x"


def test_bloom_lets_every_listed_key_pass(spark):
    keys = spark.range(5000).selectExpr("concat('h', id, '.org/') as key")
    bits = url_filter._with_bits(keys, 313)
    passed = bits.join(url_filter.bloom(keys, 313), "block").where(" and ".join(f"(w{i} & m{i}) = m{i}" for i in range(4)))
    assert passed.count() == 5000
    other = url_filter._with_bits(spark.range(5000).selectExpr("concat('x', id, '.com/') as key"), 313).join(url_filter.bloom(keys, 313), "block").where(" and ".join(f"(w{i} & m{i}) = m{i}" for i in range(4)))
    assert other.count() < 500


def test_op5_screen_loses_less_than_the_bands():
    n, k = near_dedup.SKETCH_BITS, near_dedup.BANDS * near_dedup.ROWS
    ones, odd, lost = np.arange(n + 1), np.eye(1, n + 1)[0], 0.0  # odd: the chance of so many odd bits after t flips
    for t in range(2 * k + 1):
        if t % 2 == 0:
            lost += math.comb(k, t // 2) * 0.2 ** (t // 2) * 0.8 ** (k - t // 2) * odd[near_dedup.most_bits() + 1 :].sum()
        after = np.zeros(n + 1)
        after[1:] += odd[:-1] * (n - ones[:-1]) / n
        after[:-1] += odd[1:] * ones[1:] / n
        odd = after
    assert lost < (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS


def test_op7_sequences(spark):
    s = dict(licenses.SENTENCES)
    full = f"Hello. {s['mit-grant'].upper()}: {s['mit-notice']}. {s['mit-warranty']}."
    broken = f"{s['mit-grant']}. Something else. {s['mit-notice']}. {s['mit-warranty']}."
    texts = [None, "", full, broken, "Licensed under the Apache License, Version 2.0.", "x\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.", "no licence here", s["apache2-head"] + ". " + s["apache2-copy"] + ". " + s["apache2-basis"] + ". " + s["apache2-see"] + "."]
    out = licenses.scan(table(spark, texts).withColumn("matched", F.lit(1)))
    got = {r["doc_id"]: (r["licences"], sorted(m["rule"] for m in r["matched"])) for r in out.collect()}
    assert got == {0: ("", []), 1: ("", []), 2: ("MIT", ["mit.text"]), 3: ("", []), 4: ("Apache-2.0", ["apache2.notice"]), 5: ("GPL-3.0,MIT", ["gpl3.notice", "mit.notice"]), 6: ("", []), 7: ("Apache-2.0", ["apache2.header"])}


MIT = """The MIT License (MIT)

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""


def test_op7_official_texts_however_wrapped(spark):
    want = {MIT: ("MIT", ["mit.text"]), APACHE: ("Apache-2.0", ["apache2.header"]), GPL: ("GPL-3.0-or-later", ["gpl3.header"]), BSD: ("BSD-3-Clause", ["bsd3.text"]), BSD.replace("3. Neither", "3. Either"): ("BSD-2-Clause", ["bsd2.text"])}
    forms = [lambda t: t, lambda t: "".join(f"# {x}\n" for x in t.split("\n")), lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */", lambda t: " ".join(t.split()), lambda t: "\n".join(t.split()), lambda t: t.replace("\n", "\r\n"), lambda t: re.sub(r"(?m)^([123])\. ", r"(\1) ", t), lambda t: re.sub(r"(?m)^[123]\. ", "* ", t)]
    texts = [f(t) for t in want for f in forms]
    part = [MIT.split("THE SOFTWARE IS")[0], APACHE.replace("Unless", "Some words. Unless"), "It is not licensed under the Apache License,\nVersion 2.0. Permission is due."]
    got = [(r["licences"], sorted(m["rule"] for m in r["matched"])) for r in licenses.scan(table(spark, texts + part)).orderBy("doc_id").collect()]
    assert got[: len(texts)] == [w for w in want.values() for _ in forms]
    assert got[len(texts) :] == [("", []), ("Apache-2.0", ["apache2.head"]), ("", [])]


def test_op7_every_sentence_has_an_anchor():
    assert all(any(a in s for a in licenses.ANCHORS) for _, s in licenses.SENTENCES)


# --- 8: decontamination ----------------------------------------------------------------------------------------


def test_lcs_against_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]


def test_op8_finds_quotes_and_paraphrases(spark, prose):
    items = [prose(40) for _ in range(6)] + [prose(130)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(90, None, ""), (91, "", "")], "item_id long, text string, lang string")
    w = items[0].split()
    changed = " ".join(prose(1) if i % 8 == 3 else x for i, x in enumerate(w))
    mangled = " ".join(x.upper() + "!!" for x in items[1].split())
    clean = [prose(200) for _ in range(30)]
    texts = [prose(90) + " " + items[0] + " " + prose(70), prose(50) + " " + changed + " " + prose(50), mangled, prose(300) + " " + items[6], *clean, *ODD]
    found = decontaminate.matches(table(spark, texts), bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(0, 0), (1, 0), (2, 1), (3, 6)}
    assert decontaminate.matches(table(spark, []), bench).isEmpty()
    assert decontaminate.matches(table(spark, texts), bench.limit(0)).isEmpty()


def test_op8_verbatim_runs_do_not_depend_on_the_latent_space(spark, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "COSINE", 2.0)  # the latent search finds nothing
    items = [prose(n) for n in (1, 4, 12, 13, 14, 30, 48, 49, 130)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    part = items[8].split()[60:75]
    texts = [*(f"{prose(40)} {x} {prose(60)}" for x in items), *items, " ".join(part), prose(20) + " " + " ".join(items[5].split()[-13:]), prose(20) + " " + " ".join(items[5].split()[-12:]), items[6].split(" ", 30)[-1], *ODD]
    n = len(items)
    want = {(i, i) for i in range(n)} | {(n + i, i) for i in range(n)} | {(2 * n, 8), (2 * n + 1, 5), (2 * n + 3, 6)}
    # a lone word may turn up by chance
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(table(spark, texts), bench).where("shared_run").collect()}
    by_chance = {(d, 0) for d, t in enumerate(texts) if items[0] in (t or "").split()}
    assert found == want | by_chance


# --- the pipeline and the registry -----------------------------------------------------------------------------


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, tiny))
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert packed.select("doc_id").distinct().count() == before


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", ["op6_url_filter", "op7_license_scan"])
def test_native_operators_match_sql_without_python(spark, tiny, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    df = queries.queries()[name](spark, tiny)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(cols).collect())))
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert got == want
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
