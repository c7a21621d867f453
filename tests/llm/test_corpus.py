from __future__ import annotations

import json
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from gleanery.llm import chat, decontaminate, html_text, jaccard, licenses, lines, mixing, quality, queries, spans, tokens
from gleanery.session import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, made string, kept string"


def frame(spark, texts, source="s"):
    """Documents with columns whose names clash with made ones."""
    return spark.createDataFrame([(i, t, "en", source, None, "r", "m", "k") for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "one two"), (5, "x " * 40_000), (6, "Straße ② naïve"),
       (7, "a line of more than twenty points\n" * 3), (8, "A line of more than twenty points "), (9, "a line of more than twenty points")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_contamination(spark, docs, rows):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    pairs = [tuple(r) for r in items.select("item_id", "text").collect()]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(brute.contamination(rows, pairs))
    assert got(decontaminate.report(docs, items), *columns) == want
    small = decontaminate.scan(docs, items, keep=["doc_id"], block_words=50, blocks_per_pass=2)  # many blocks, many passes
    assert got(small, "row.doc_id", "hits.n_hit", F.size("hits.items").alias("n")) == [(r[0], r[2], r[3]) for r in want]
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in want if not r[5]}


def test_contamination_odd(spark):
    words = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, words), (1, words), (2, "Short item"), (3, None), (4, "..."), (None, "w1 w2 w3")], "item_id long, text string")
    texts = [*ODD, (10, "a SHORT, item!"), (11, "z " * 300 + " ".join(words.split()[5:20])), (12, "w1 w2 w3")]
    pairs = [tuple(r) for r in items.collect()]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    result = decontaminate.report(frame(spark, texts), items).select(*columns).collect()
    assert sorted(map(str, map(tuple, result))) == sorted(map(str, brute.contamination(texts, pairs)))
    assert decontaminate.report(frame(spark, []), items).count() == 0
    assert decontaminate.report(frame(spark, texts), items.limit(0)).where("n_hit > 0").count() == 0
    cut = decontaminate.decontaminate(frame(spark, [(1, "z " * 700 + words + " end.")]), items, max_length=13)
    assert cut.first()["text"] == "z " * 700 + " end."


def test_html_of_all_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for row in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert row["text"] == "\n\n".join(p for p in parts if p)
        assert row["n_chars"] == len(row["text"])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p> </p><script>x</script>", ""), ("just text", "just text"), ("a < b &amp; c", "a < b & c"),
    ("<body><div class='menu'><a href=x>Home</a></div><div id=main><h1>T</h1><p>One, two. Three &lt;four&gt;.<p>Five,\n six.</div>"
     "<div class=comments><p>Nice one, really. I like it.</p></div><footer>f</footer>", "T\n\nOne, two. Three <four>.\n\nFive, six."),
    ("<article><header><h1>Head</h1><p>by me</p></header><p>Text, more text.</p><aside>no</aside><form>no</form></article>",
     "Head\n\nText, more text."),
    ("<p>open <!-- never closed", "open"), ("<div><p>a. b, c.</p><script>if (a<b) '</p>'</script><p>d. e, f.</p></div>", "a. b, c.\n\nd. e, f."),
])
def test_html_odd(page, text):
    assert html_text.article(page) == text


def test_html_keeps_all_content():
    lead = "A lead paragraph in a division of its own, with some words, that opens the page."
    text = [f"Paragraph {i} of the page, " + "with many words, and more of them, " * 12 + "and an end." for i in range(10)]
    close = "The closing section stands in another division, and is short, but it is text."
    page = (f'<body><header><h1>Title</h1></header><div class=page><div class=intro><p>{lead}</p></div>'
            f'<div class=text>{"".join(f"<p>{t}</p>" for t in text)}</div><div class=end><p>{close}</p></div></div></body>')
    assert html_text.article(page) == "\n\n".join([lead, *text, close])


@pytest.mark.parametrize("wrapper", ["form method=post", 'div class="has-sidebar"', 'div id="content-with-sidebar"', 'div class="nav-open"',
                                     'form class="layout-notice"'])
@pytest.mark.parametrize("around", ["", '<div class="ad">Buy now, it is cheap.</div>'])
def test_html_wrapped_page(wrapper, around):
    text = [f"Paragraph {i} of the page has words, commas, and an end." for i in range(6)]
    inside = f'<h1>Title</h1>{"".join(f"<p>{t}</p>" for t in text)}<div class="comments"><p>First!</p></div>'
    page = f"<body>{around}<{wrapper}>{inside}</{wrapper.split()[0]}><footer>Imprint, address.</footer></body>"
    assert html_text.article(page) == "\n\n".join(["Title", *text])


PARAGRAPHS = [f"Paragraph {i} of the page has words, commas, and an end, and some more words." for i in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize("before, after, added", [
    ('<article><h1>T</h1>', '<section id="discussion"><h2 id="legal-status">Legal status</h2><p class="side-note">Short note.</p>'
     '<p>More of it, with words.</p></section><div class="related-work"><p>Others did this too, long ago.</p></div></article>',
     ["Legal status", "Short note.", "More of it, with words.", "Others did this too, long ago."]),
    ('<article><h1>T</h1>', '<p>It is <span class="popular">the famous</span> rule of <em id="copyright">law</em>.</p></article>',
     ["It is the famous rule of law."]),
    ('<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><h1>T</h1>', '<p><a href=x>Buy cheap things now, and save</a></p>'
     '<h2>Related</h2><ul><li><a href=c>Another story, with a long title</a></li></ul>', []),
    ('<nav><a href=x>n</a></nav><div><h1>T</h1>', '<ul><li>one</li><li>two <a href=q>x</a></li></ul><table><tr><td>1</td><td>2</td></tr></table></div>',
     ["one", "two x", "1", "2"]),
    (f'<div class="ad">{"Buy this thing, now, it is cheap. " * 20}</div><article><h1>T</h1>',
     f'</article><section class="comments"><h3>Comments</h3><p>{"I like it, a lot. " * 30}</p></section>', []),
    ('<article><h1>T</h1>', f'<h2>Comments</h2><div id="comments"><p>{"Nice one, really. " * 20}</p></div></article>', []),
    ('<div class="notice">We use cookies, you know. Accept them.</div><h1>T</h1>', '<footer>f, g. h</footer>', []),
    ('<article><h1>T</h1>', '<h2>Last</h2><div class="ad">Buy.</div><p>End.</p></article>', ["Last", "End."]),
])
def test_html_marks_weigh(before, after, added):
    assert html_text.article(f"<body>{before}{BODY}{after}</body>") == "\n\n".join(["T", *PARAGRAPHS, *added])


@pytest.mark.parametrize("page, text", [
    ("<body><nav><a href=x>Home</a></nav><div><a href=y>A link</a></div></body>", ""), ("<article><h1>T</h1><p>Hi.</p></article>", "T\n\nHi."),
    ("<article><h1>Only a title</h1></article>", "Only a title"), ("<p>" + "long, text. " * 200_000 + "</p>", ("long, text. " * 200_000).strip()),
    ("<div>" * 5000 + "deep, text." + "</div>" * 5000, "deep, text."),
])
def test_html_without_much(page, text):
    assert html_text.article(page) == text


def test_html_tables(spark):
    rows = [(1, "u", None, "a", "b"), (1, None, f"<article>{BODY}</article>", "a", "b"), (1, None, f"<article>{BODY}</article>", "a", "b"), (None, "u", "", "a", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    whole = "\n\n".join(PARAGRAPHS)
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, None, whole, len(whole)), (1, None, whole, len(whole)), (None, "u", "", 0)], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_links(spark, docs, rows):
    for options in (jaccard.QUERY, jaccard.PIPELINE):
        want = brute.linked(rows, options["width"], options["num"], options["den"])
        assert got(jaccard.linked(docs, **options), "doc_id", "n_shingles", "component_id") == want
        kept = jaccard.keep_first(docs, **options)
        assert kept.columns == docs.columns
        assert sorted(r[0] for r in kept.select("doc_id").collect()) == [d for d, _, c in want if d == c]


def test_links_odd(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [*ODD, (20, " ".join(base)), (21, " ".join(base).upper())]
    texts += [(30 + i, " ".join([*base[:i * 2], "new", *base[i * 2:]])) for i in range(60)]  # a chain of near copies
    result = {(r[0], r[1]): r[2] for r in jaccard.report(frame(spark, texts)).collect()}
    unique = [t for t in dict(texts).items() if t[0] is not None]
    assert {k: v for k, v in result.items() if k[0] is not None} == {(d, n): c for d, n, c in brute.linked(unique, 3, 90, 100)}
    assert jaccard.report(frame(spark, [])).count() == 0
    kept = got(jaccard.keep_first(frame(spark, [t for t in texts if t[0] is not None])), "doc_id")
    assert kept.count((4,)) == 1 and (2,) in kept and (21,) not in kept


def test_bands_cover_partners():
    for bands in (jaccard.Bands(90, 100), jaccard.Bands(80, 100)):
        for n in range(1, 3000):
            for m in {n, -(-n * bands.num // bands.den)}:  # the smallest partner
                assert not bands.differ(m) or set(bands.ways(m)[-1:]) <= set(bands.ways(n))
            assert all(bands.parts(b) > bands.differ(n) for b in bands.ways(n))


def test_sets_with_too_few_pieces(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard.Bands, "parts", lambda self, band: 3)  # hardly any set fills more than d of three parts
    for options in (jaccard.QUERY, jaccard.PIPELINE):
        want = brute.linked(rows, options["width"], options["num"], options["den"])
        assert got(jaccard.linked(docs, **options), "doc_id", "n_shingles", "component_id") == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\t\x0bé漢", max_size=30), max_size=6), st.sampled_from([4, 64, 1 << 16]))
def test_words_of_a_batch_are_hashed_alike(texts, block):
    usual, jaccard.BLOCK = jaccard.BLOCK, block
    try:
        raw = [t.encode() if t else None for t in texts]
        words = [brute.plain_words(t.translate(brute.LOWER)) for t in texts]
        short = {w for own in words for w in own if len(w.encode()) <= block}
        one = {w: int(jaccard.word_hashes(w.encode())[1][0]) for w in short}
        assert len(set(one.values())) == len(one)
        for text, own, found in zip(raw, words, jaccard.shingle_sets(raw, 1)):
            assert len(found) == len(set(own)) and {one[w] for w in own if w in one} <= set(
                jaccard.word_hashes((text or b"").translate(jaccard.LOWER))[1].tolist())
    finally:
        jaccard.BLOCK = usual


def test_sketches_fold(spark):
    random = np.random.default_rng(4)
    own = random.integers(0, 1 << 63, 1100).astype(np.uint64)
    for other in (own[:1000], own[100:], random.integers(0, 1 << 63, 950).astype(np.uint64)):
        row = spark.createDataFrame([tuple([int(x) for x in jaccard.short_sketch(a).view(np.int64)] for a in (own, other))], "a array<long>, b array<long>")
        size = min(len(jaccard.short_sketch(own)), len(jaccard.short_sketch(other)))
        folded = [np.bitwise_xor.reduce(jaccard.short_sketch(x).reshape(-1, size), axis=0) for x in (own, other)]
        want = int(np.bitwise_count(folded[0] ^ folded[1]).sum())
        assert row.select(jaccard.apart("a", "b")).first()[0] == row.select(jaccard.apart("b", "a")).first()[0] == want
        assert want <= len(np.setxor1d(own, other))


def test_pieces_meet():
    """Sets that just link have a piece in common, whatever they are."""
    random = np.random.default_rng(3)
    for options in (jaccard.QUERY, jaccard.PIPELINE):
        bands = jaccard.Bands(options["num"], options["den"])
        for n in [*range(2, 90), *range(100, 2000, 97)]:
            own = random.integers(0, 1 << 63, n).astype(np.uint64)
            d = bands.differ(n)
            for lost in {0, d // 2, d}:
                other = np.concatenate([own[lost:], random.integers(0, 1 << 63, d - lost).astype(np.uint64)])
                if min(n, len(other)) * options["den"] < max(n, len(other)) * options["num"] or (n - lost) * options["den"] < (
                        n + d - lost) * options["num"]:
                    continue
                (keys, short), (others, other_short) = jaccard.pieces(own, bands), jaccard.pieces(other, bands)
                if d and not short and not other_short:
                    assert len(np.intersect1d(np.concatenate(keys), np.concatenate(others)))
            assert not d or not jaccard.pieces(own, bands)[1]


def test_mix(spark, docs, rows):
    result = mixing.mix(docs, ["doc_id", "source"]).select("row.*", "size", "source_size", "target", "taken").collect()
    sizes = {d: len(brute.plain_words(t)) for d, t in rows}
    names = sorted({r["source"] for r in result})
    whole = [sum(r["size"] for r in result if r["source"] == s) for s in names]
    want = brute.water_fill(whole, [i % 3 + 1 for i in range(len(names))], 3)
    for s, size, target in zip(names, whole, want):
        mine = [r for r in result if r["source"] == s]
        assert all(r["size"] == sizes[r["doc_id"]] and r["source_size"] == size for r in mine)
        assert all(r["target"] == pytest.approx(target) and r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= max(r["size"] for r in mine)
    assert got(mixing.report(docs), "doc_id", "taken") == got(mixing.report(docs.repartition(3)), "doc_id", "taken")
    assert mixing.mixed(docs).columns == docs.columns


def test_mix_odd(spark):
    result = mixing.mix(frame(spark, ODD).withColumn("source", F.when(F.col("doc_id") == 5, "big")))
    assert result.count() == len(ODD) and result.where("size = 0 AND taken > 0").count() == 0
    assert result.where("taken > 3 * size").count() == 0
    assert mixing.mixed(frame(spark, [])).count() == 0


def test_mix_of_rows_with_one_id(spark):
    """Rows of one id, or none, and equal rows are picked one by one: each source's words come near its target."""
    rows = [(None, f"w{i} x y z", "a") for i in range(300)] + [(7, "the same row", "b")] * 300 + [(i, "p q", "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    result = mixing.mix(docs, ["doc_id", "source"]).select("row.source", "size", "target", "taken").collect()
    assert len(result) == 900
    for source in "abc":
        mine = [r for r in result if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.1 * mine[0]["target"]
    again = mixing.mix(docs.repartition(7), ["doc_id", "source"]).select("row.source", "size", "target", "taken").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, result))


def test_spans(spark):
    passage = "Ein erster Satz mit sieben Worten hier. Der zweite Satz hat auch einige Worte dabei und geht noch etwas weiter. Und ein dritter Satz beendet die Stelle nun ganz."
    texts = [(1, f"Start of one. {passage} End of one."), (2, f"Other words before {passage} Other words after."),
             (3, f"Nothing. {passage.upper()}"), (4, "Clean text. Short. Short."), *[(i + 100 if i else None, t) for i, t in ODD[:3]]]
    result = {r["doc_id"]: r for r in spans.report(frame(spark, texts)).collect()}
    assert result[1]["n_removed"] == 0 and result[1]["text"] == texts[0][1]
    assert result[2]["text"] == "Other words before Ein erster Satz mit sieben Worten hier. Other words after."
    assert result[2]["first_doc_ids"] == [1] and result[3]["text"] == "Nothing. "
    assert result[4]["text"] == texts[3][1] and result[101]["text"] is None
    again = spans.report(frame(spark, [texts[0], texts[0]])).collect()  # one document twice
    assert [r["n_removed"] for r in again] == [0, 0]
    assert spans.report(frame(spark, [])).count() == 0
    assert spans.dedup_spans(frame(spark, texts)).columns == frame(spark, []).columns


def brute_all_runs(rows):
    """Sentences to remove per document, over all runs."""
    first, spots, ids = {}, {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0], spans.tie_of((r[1] or "").encode()))):
        keys = [tuple(w) for w in spans.keys_of(text or "")]
        for start in range(len(keys)):
            run, n, last = None, 0, start
            for end in range(start + 1, len(keys) + 1):
                run = ids.setdefault((run, keys[end - 1]), len(ids))  # one number to each run of sentences
                n += len(keys[end - 1])
                if n >= 20 and (end - start >= 2 or n >= 25) and first.setdefault(run, (doc, start)) != (doc, start):
                    last = end
            if last > start:
                spots.setdefault(doc, set()).update(range(start, last))
    return {d: len(s) for d, s in spots.items()}


def test_spans_cover_the_tail_of_a_passage(spark):
    sentence = lambda name, n: " ".join(f"{name}{k}" for k in range(n)) + "."
    passage = f"{sentence('a', 30)} {sentence('b', 24)}"
    texts = [(1, f"One. {passage} {sentence('c', 9)}"), (2, f"Two. {passage} {sentence('d', 9)}")]
    result = {r["doc_id"]: r for r in spans.report(frame(spark, texts)).collect()}
    assert result[1]["n_removed"] == 0 and result[2]["n_removed"] == 2
    assert result[2]["text"] == f"Two. {sentence('d', 9)}"


def test_spans_are_those_of_all_runs(spark):
    random = np.random.default_rng(5)
    made = [" ".join(f"s{i}w{k}" for k in range(n)) + "." for i, n in enumerate((1, 3, 8, 12, 19, 21, 24, 25, 30, 40))]
    texts = [(d, " ".join(made[i] for i in random.integers(0, len(made), random.integers(1, 9)))) for d in range(60)]
    result = spans.report(frame(spark, texts)).where("n_removed > 0").collect()
    assert {r["doc_id"]: r["n_removed"] for r in result} == brute_all_runs(texts)


def test_spans_of_all_documents_over_all_runs(docs, rows):
    result = spans.report(docs).where("n_removed > 0").collect()
    assert {r["doc_id"]: r["n_removed"] for r in result} == brute_all_runs(rows)


def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.tokenizer_path())
    made.encode_special_tokens = True
    return made


def test_token_files(spark, docs, rows):
    report = tokens.report(docs, new_path(spark, "tokens"), queries.tokenizer_path())
    assert got(report, "doc_id", "start", "n_tokens", "ids_crc32") == brute.tokens(rows, tokenizer())
    path = new_path(spark, "tokens")
    tokens.write_tokens(docs, path, queries.tokenizer_path(), file_tokens=500)  # many files
    assert got(tokens.read_tokens(spark, path), "doc_id", "start") == got(report, "doc_id", "start")


def test_token_files_odd(spark):
    result = tokens.report(frame(spark, ODD), new_path(spark, "tokens"), queries.tokenizer_path()).orderBy("start").collect()
    assert [r["doc_id"] for r in result] == sorted((d for d, _ in ODD), key=lambda d: -1 if d is None else d)
    assert [r["n_tokens"] for r in result if r["doc_id"] in (1, 2)] == [1, 1]
    assert tokens.report(frame(spark, []), new_path(spark, "tokens"), queries.tokenizer_path()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abA1 \n\t'.,;?s　\xa0éß日。#ж<|endoftext>", max_size=40))
def test_pieces_are_the_whole(text):
    encoder = tokens.Encoder(queries.tokenizer_path())
    assert encoder.encode([text])[0] == encoder.whole(text)


def test_words_are_forgotten_by_use(rows, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 300)
    encoder, texts = tokens.Encoder(queries.tokenizer_path()), [t for _, t in rows if t]
    for i in range(0, len(texts), 7):
        some = texts[i:i + 7]
        assert encoder.encode(some) == [encoder.whole(t) for t in some]
        encoder.known.forget(300)
        assert len(encoder.known) <= 300


def test_words_are_remembered_by_the_next_task(monkeypatch):
    first = tokens.Encoder(queries.tokenizer_path())
    want = first.encode(["some words"])
    monkeypatch.setattr(tokens.Encoder, "word", lambda self, word: pytest.fail(word))
    assert tokens.Encoder(queries.tokenizer_path()).encode(["some words"]) == want


def test_runs_of_white_space_are_cut_as_a_whole_text_would_be(monkeypatch):
    texts = ["a  b", "", " \n", "one.\n\n\ttwo \r\n  three!?  ", "\n", "it's 'so', é. x.y", " a", "b "]
    encoder = tokens.Encoder(queries.tokenizer_path())
    want = [encoder.whole(t) for t in texts]
    monkeypatch.setattr(tokens.Encoder, "whole", lambda self, text: pytest.fail(text))
    assert encoder.encode(texts) == want
    assert encoder.encode(pa.array(["before", *texts, "after"])[1:-1]) == want and encoder.encode([]) == []


def test_a_word_is_asked_for_once_for_many_texts():
    class Asked(tokens.Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    asked, encoder, texts = [], tokens.Encoder(queries.tokenizer_path()), ["the cat. the cat\nthe cat", "the cat, the cat."] * 9
    encoder.known = Asked(encoder.word)
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]
    assert sorted(asked) == sorted({"the", " cat", " the", ".", ",", "\n"})


def test_rounds_without_links_keep_the_components(spark, monkeypatch):
    """Components are walked anew only where a round finds links, and then give the least doc_id of all they join."""
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    job = jaccard.Join(frame(spark, [(1, text(1)), (2, text(2)), (3, text(2)), (4, text(4))]), 3, 90, 100)
    labels = spark.createDataFrame([(5, 5), (7, 5), (2, 2), (9, 2)], "node long, component long")
    pairs = spark.createDataFrame([(2, 3)], "a long, b long")
    walked, usual = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: walked.append(1) or usual(edges))
    monkeypatch.setattr(job, "verify", lambda pairs: pairs.limit(0))
    assert job.more(labels, pairs) is labels and not walked
    found = spark.createDataFrame([(7, 9), (1, 3), (3, 7)], "a long, b long")
    monkeypatch.setattr(job, "verify", lambda pairs: found)
    assert got(job.more(labels, pairs), "node", "component") == [(n, 1) for n in (1, 2, 3, 5, 7, 9)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=700))
def test_elias_fano(values):
    values = np.array(sorted(values), np.uint64)
    data = b"pad" + tokens.EliasFano.of(values).dump()
    coded, end = tokens.EliasFano.load(memoryview(data), 3)
    assert end == len(data) and coded.run(0, len(values)).tolist() == values.tolist()
    for first in range(0, len(values), 97):
        assert coded.run(first, first + 130).tolist() == values[first:first + 130].tolist()
    assert [coded[i] for i in range(len(values))] == values.tolist()


def test_licenses(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    found = licenses.scan(docs, licenses.known_texts(spark))
    assert got(found, "doc_id", "scope", "position", "license_id") == sorted(con.execute(licenses.ORACLE).fetchall())
    mit, zlib = dict(licenses.KNOWN[:1])["MIT"], licenses.KNOWN[5][1]
    texts = [*ODD, (20, "Copyright (c) 2020 Me\nAll rights reserved.\n\n" + mit.upper().replace(",", " ")),
             (21, "Prose.\n\n" + "released under the MIT licence!"), (22, zlib.replace("acknowledgment", "Acknowledgement")), (23, mit + " more")]
    assert got(licenses.scan(frame(spark, texts), licenses.known_texts(spark)), "doc_id", "scope", "license_id") == [
        (20, "document", "MIT"), (21, "line", "MIT"), (22, "document", "Zlib")]


def test_licenses_with_titles_and_in_runs_of_blocks(spark):
    texts = dict((name, text) for name, text in licenses.KNOWN[:8])
    bsd3 = licenses.WHOLE[0][1]
    holder = "Copyright (c) 2020 Me"
    files = [(1, f"MIT License\n\n{holder}\n\n{texts['MIT']}"), (2, f"The MIT License (MIT)\n{holder}\n\n{texts['MIT']}\n"),
             (3, f"BSD 2-Clause License\n\n{holder}\n\n{texts['BSD-2-Clause']}"), (4, f"ISC License\n\n{texts['ISC']}"),
             (5, f"zlib License\n\n{holder}\n\n{texts['Zlib']}"), (6, f"BSD 3-Clause License\n\n{holder}\n\n{bsd3}"),
             (7, f"A manual.\n\nIts license:\n\n{holder}\n\n{texts['MIT']}\n\nThe end.\n\n{texts['ISC']}"),
             (8, texts["BSD-2-Clause"].replace("\n\n2. ", "\n2. ") + "\n\nMore."), (9, "MIT License"),
             (10, "A line on the MIT License here.\n\n" + texts["MIT"][:-5]), (11, texts["BSL-1.0"].partition("\n\n")[2])]
    assert got(licenses.scan(frame(spark, files), licenses.known_texts(spark)), "doc_id", "scope", "position", "license_id") == [
        (1, "document", 0, "MIT"), (2, "document", 0, "MIT"), (3, "document", 0, "BSD-2-Clause"), (4, "document", 0, "ISC"),
        (5, "document", 0, "Zlib"), (6, "document", 0, "BSD-3-Clause"), (7, "block", 3, "MIT"), (7, "block", 7, "ISC"),
        (8, "block", 0, "BSD-2-Clause"), (11, "document", 0, "BSL-1.0")]


def test_quality(docs, rows):
    report = quality.report(docs)
    assert got(report.drop("kept"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(brute.quality(rows))
    whole = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    want = brute.kept(whole)
    assert {r["doc_id"]: r["kept"] for r in report.collect()} == want and len(set(want.values())) == 2
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_odd(spark):
    odd = frame(spark, ODD).withColumn("lang", F.when(F.col("doc_id") > 5, "en"))
    assert quality.judge(odd).where("kept").count() == 0  # all have few words or one word again and again
    assert quality.report(frame(spark, [])).count() == 0
    prose = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(60))) for i in range(400)]
    marked = (1000, " ".join(f"w{k}###" for k in range(60)))
    verdicts = {r["doc_id"]: r["kept"] for r in quality.report(frame(spark, [*prose, marked])).collect()}
    assert not verdicts[1000] and sum(verdicts.values()) == 400


def test_quality_by_language(spark):
    prose = lambda i, word: " ".join(f"{word}{(i * 7 + k * k) % 997:03}" for k in range(60))
    short = [(i, prose(i, "w"), "en") for i in range(400)]
    long = [(1000 + i, prose(i, "longwordsof"), "de") for i in range(30)]  # longer words than the majority's
    rare = [(2000, prose(0, "w"), "fr"), (2001, prose(1, "muchlongerwordsofanother"), "fr")]
    marked = [(3000, " ".join(f"longwordsof{k:03}###" for k in range(60)), "de"), (3001, prose(1, "w" * 40), "de")]
    texts = [*short, *long, *rare, *marked]
    docs = frame(spark, [(i, t) for i, t, _ in texts]).drop("lang").join(
        spark.createDataFrame([(i, lang) for i, _, lang in texts], "doc_id long, lang string"), "doc_id")
    verdicts = {r["doc_id"]: r["kept"] for r in quality.report(docs).collect()}
    assert sorted(i for i, kept in verdicts.items() if not kept) == [3000, 3001]


def test_quality_blends_by_count(spark):
    prose = lambda i, word: " ".join(f"{word}{(i * 7 + k * k) % 997:03}" for k in range(60))

    def kept(others):  # 10 documents of a small source, with words of 6 letters among those of 4
        texts = [(i, prose(i, "w")) for i in range(others)]
        small = frame(spark, [(9000 + i, prose(i, "www")) for i in range(10)], "small")
        report = quality.judge(frame(spark, texts).unionByName(small), weight=5)
        return report.where("kept AND row.doc_id >= 9000").count()

    assert kept(100) == kept(1000) == 10  # its own count weighs, not the size of the table


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5))
def test_repeated_words(texts):
    raw = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert quality.measure(None, [t.encode() for _, t in raw])["n_repeat_words"].to_pylist() == [r[5] for r in brute.quality(raw)]


def test_lines(spark, docs, rows):
    columns = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got(lines.report(docs), *columns) == sorted(brute.lines(rows))
    small = lines.drop_lines(docs, ["doc_id"], shard_lines=2, pass_lines=4)  # many shards, many passes
    assert got(small, "row.doc_id", F.size("lines.dropped").alias("n")) == [(r[0], r[2]) for r in sorted(brute.lines(rows))]
    assert lines.dedup_lines(docs).columns == docs.columns


def test_lines_odd(spark):
    result = {r["doc_id"]: r for r in lines.report(frame(spark, ODD)).collect()}
    assert (result[7]["n_lines"], result[7]["n_dropped"]) == (4, 3)
    assert result[8]["n_dropped"] == 1 and result[9]["n_dropped"] == 0 and result[1]["n_lines"] == 1
    only_null = [(None, "a line of more than twenty points")] * 3
    assert lines.report(frame(spark, only_null)).where("n_dropped > 0").count() == 0
    assert lines.report(frame(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=500))
def test_perfect_hash(values):
    keys = np.array(sorted(values), np.uint64)
    made = lines.PerfectHash(keys)
    assert sorted(made.numbers(keys).tolist()) == list(range(len(keys)))


CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, depends_on array<string>"


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 1, "search", '{"limit": 3, "query": "x"}', []), (1, "b", 3, "lookup", '{ "key":"k","exact":true }', ["a", "gone"]),
        (1, "c", 5, "store", '{"items": [1, {"z":1,"y":2}], "note": "n"}', ["b", "a"]), (1, "d", 7, "search", "no json", None),
        (1, "e", 9, "search", '{"limit": "3", "extra": 1}', ["f"]), (1, "f", 11, "nothing", "{}", ["e"]),
        (1, "a", 13, "search", '{"limit": 3, "query": "x"}', []), (2, "a", 1, "lookup", "[1]", []),
        (None, "n", 1, "search", '{"limit": 3, "query": "x"}', []), (2, "r", 2, "search", '{"limit": 300, "query": "x"}', [])], CALLS)
    results = spark.createDataFrame([(1, "a", 2, 'say "hi"\n'), (1, "zz", 4, "lost"), (1, "a", 6, "later"), (1, "b", 4, None)],
                                    "conv_id long, call_id string, turn long, content string")
    out = chat.link(calls, results, spark.createDataFrame(chat.TOOLS, chat.SCHEMA)).collect()
    by = {(r["conv_id"], r["call_id"], r["turn"], r["part"]): r for r in out}
    assert len(out) == 14
    assert [by[1, x, t, 0]["level"] for x, t in (("a", 1), ("b", 3), ("c", 5))] == [0, 1, 2]
    assert by[1, "a", 1, 0]["valid"] and by[1, "a", 1, 0]["json"] == (
        '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","role":"assistant","type":"tool_call"}')
    assert json.loads(by[1, "a", 1, 1]["json"])["content"] == 'say "hi"\n'
    assert by[1, "b", 3, 0]["errors"] == ["missing_dependency:gone"] and by[1, "b", 3, 1]["json"].startswith('{"content":null')
    assert '{"items":[1,{"y":2,"z":1}],"note":"n"}' in by[1, "c", 5, 0]["json"]
    assert by[1, "d", 7, 0]["errors"] == ["bad_json", "unanswered"]
    assert by[1, "e", 9, 0]["errors"] == ["cycle", "missing:query", "type:limit", "unanswered", "unknown:extra"]
    assert "unknown_tool" in by[1, "f", 11, 0]["errors"]
    assert by[1, "a", 13, 0]["errors"] == ["duplicate_id"] and by[1, "a", 6, 1]["errors"] == ["duplicate_id"]
    assert by[1, "zz", 4, 1]["errors"] == ["orphan"] and by[2, "a", 1, 0]["errors"] == ["not_an_object", "unanswered"]
    assert by[None, "n", 1, 0]["errors"] == ["no_id"] and by[2, "r", 2, 0]["errors"] == ["range:limit", "unanswered"]
    empty = chat.link(calls.limit(0), results.limit(0), spark.createDataFrame(chat.TOOLS, chat.SCHEMA))
    assert empty.count() == 0


def test_tool_calls_of_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role").collect()]
    calls = {(c, t) for c, t, role in rows if role == "assistant"}
    answers = {(c, t - 1) for c, t, role in rows if role == "user" and t > 0}
    out = queries.QUERIES["op10_tool_calls"](spark, SF).collect()

    def level(c, t):
        return level(c, t // 2) + 1 if t // 2 > 0 and (c, t // 2) in calls else 0

    assert {(r["conv_id"], r["turn"]): r["level"] for r in out if r["part"] == 0} == {k: level(*k) for k in calls}
    assert {(r["conv_id"], r["turn"] - ("orphan" in r["errors"])) for r in out if r["part"] == 1} == answers
    assert {(r["conv_id"], r["turn"]) for r in out if r["part"] == 0 and "unanswered" in r["errors"]} == calls - answers
    assert all(json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in out)


def test_pipeline(spark, docs, rows):
    """Each stage is held against the rules on what its predecessor kept."""
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, None
        path = new_path(spark, name)
        stage(spark, before, SF).write.parquet(path)
        now = spark.read.parquet(path)
        mine = [tuple(r) for r in before.select("doc_id", "text").collect()]
        if name != "token_files":
            assert now.columns == docs.columns
            kept = sorted(r[0] for r in now.select("doc_id").collect())
        if name == "quality_rules":
            assert not set(kept) & {r[0] for r in brute.quality(mine) if r[6]}
        elif name == "near_duplicates":
            assert kept == [d for d, _, c in brute.linked(mine, 5, 80, 100) if d == c]
        elif name == "benchmark_passages":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert kept == sorted(r[0] for r in brute.contamination(mine, items) if not r[5])
        elif name == "source_mix":
            assert max(kept.count(d) for d in set(kept)) <= 3
    assert now.count() == len(mine) and now.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == now.agg(F.sum("n_tokens")).first()[0]


def test_every_operator_is_a_query():
    import __spark_entry__ as entry

    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
    assert "pipeline" in entry.queries() and Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"
