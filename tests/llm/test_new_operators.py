from __future__ import annotations

import time

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import brute
from gleanery.llm import fim, negatives, pii, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, made string, given string"
VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, block string"


def frame(spark, texts):
    """Documents with columns whose names clash with made ones."""
    return spark.createDataFrame([(i, t, "en", "s", None, "r", "m", "g") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def as_set(rows):
    return sorted(map(repr, map(tuple, rows)))


# Fill in the middle

FIM = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
ODD = [(1, None), (2, ""), (3, "\n"), (4, "one"), (4, "one"), (None, "a\nb\nc"), (None, "a\nb\nc"), (5, "é\n" * 50_000), (6, "Straße ②\n\n\nnäïve 𝒳\r\n"),
       (7, "has <P> in it\nx"), (8, "x" * 300_000), (9, "a\n\nb"), (10, "<S>"), (11, "<p>\n<M\n>"), (12, "一二三\n四五六" * 3000), (-5, "minus\none\n")]


def test_middles(spark, docs, rows):
    done = fim.report(docs)
    assert as_set(done.select(*FIM).collect()) == as_set(brute.fill_in_middle(rows))
    assert done.where("restored_sha256 <> sha2((SELECT ''), 256)").count() > 100
    assert {r[0] for r in done.select("form").distinct().collect()} >= {"psm", "spm"}


def test_middles_odd(spark):
    assert as_set(fim.report(frame(spark, ODD)).select(*FIM).collect()) == as_set(brute.fill_in_middle(ODD))
    assert fim.report(frame(spark, [])).count() == 0
    whole = fim.fill_in_middle(frame(spark, ODD))
    assert whole.columns == frame(spark, ODD).columns
    assert {r["row"] + r["made"] for r in whole.collect()} == {"rm"}
    plain = fim.transform(frame(spark, ODD), ["doc_id"], cut_percent=0)
    assert plain.where("made.form <> 'plain'").count() == 0
    form = fim.transform(frame(spark, ODD), spm_percent=0).where("made.form = 'spm'")
    assert form.count() == 0


def test_middles_sql(spark, docs):
    docs = f"{SF}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{docs}'")
    result = con.execute(fim.ORACLE)
    names = [d[0] for d in result.description]
    assert as_set(fim.report(spark.read.parquet(docs)).select(*names).collect()) == as_set(result.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\né漢𝒳 ", max_size=400), max_size=4), st.integers(0, 3))
def test_lines_from_chunks(parts, longest):
    memory = fim.Memory(most=2000)
    for text in (*parts, "".join(parts) * 3):
        raw = text.encode()
        ends = fim.chunk_ends(raw)
        # Any cut into chunks, by the hash or by hand, gives the same lines.
        for own in (ends.tolist(), list(range(1, len(raw), 7 + longest))):
            lines = fim.Lines(raw, own, memory)
            units = brute.re.findall(r"[^\n]*\n|[^\n]+", text)
            assert lines.n == len(units)
            for k in range(len(units) + 1):
                head = "".join(units[:k])
                assert lines.after(k) == (len(head.encode()), len(head))
    assert memory.held <= 2000


def test_shared_chunks_are_met_again():
    import random

    words = random.Random(1)
    passage = "".join(words.choice("abcdefgh \n") for _ in range(200_000)).encode()
    memory = fim.Memory()
    for lead in (b"", b"another beginning\n", b"x"):
        text = lead + passage
        fim.Lines(text, fim.chunk_ends(text).tolist(), memory)
    assert memory.found > 1.9 * memory.made - 10  # the second and the third text find all but their first chunk
    memory.known = {k: fim.Chunk(b"other") for k in memory.known}  # a hash that meets by chance is not believed
    assert fim.Lines(passage, fim.chunk_ends(passage).tolist(), memory).n == passage.count(b"\n") + (not passage.endswith(b"\n"))


def test_chunks_do_not_hang_on_blocks(monkeypatch):
    import random

    text = bytes(random.Random(2).choices(range(256), k=50_000))
    want = fim.chunk_ends(text).tolist()
    monkeypatch.setattr(fim, "BLOCK", 1000)
    assert fim.chunk_ends(text).tolist() == want and len(want) > 10


# Hard negatives

FOUND = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_negatives(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute.hard_negatives([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])
    assert as_set(negatives.report(table).select(*FOUND).collect()) == as_set(want) and want
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ready = negatives.prepared(table.repartition(5), label=label)
    small = negatives.hard_negatives(ready, F.col("id") % 100 == 0, anchor_bytes=1024)  # two anchors a block
    assert as_set(small.collect()) == as_set(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    result = con.execute(negatives.ORACLE)
    assert as_set(negatives.report(table).select(*[d[0] for d in result.description]).collect()) == as_set(result.fetchall())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "i", "v", "b") for i, v, label in rows], VECTORS)


def test_negatives_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [1.0, 0.5], 3),
            (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (8, [None, 1.0], 2), (9, [1.0, 1.0], None), (None, [1.0, 0.5], 2),
            (200, [-1.0, -0.5], 2), (10, [0.0, 0.0], 2), (11, [0.0, 0.0], 4), (300, [0.0, 0.0], 4), (14, [0.95, 0.5], 9), (12, [0.95, 0.5], 0),
            (3, [0.95, 0.5], 2)]
    rows += [(1000 + i, [0.97, 0.5], i % 4) for i in range(90)]  # ties
    assert as_set(negatives.report(vectors(spark, rows)).collect()) == as_set(brute.hard_negatives(rows))
    assert negatives.report(vectors(spark, [])).count() == 0
    assert negatives.report(vectors(spark, [(0, [1.0], 1)])).count() == 0
    assert negatives.report(vectors(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])).count() == 1  # scores of 0
    huge = [(0, [1e30, 1e30], 1), (1, [1e30, 1e30], 1), (2, [1e30, 1e30], 2), (4, [1e-3], 2)]
    assert [r["negative_id"] for r in negatives.report(vectors(spark, huge)).collect()] == [1]  # 0 has the label of 2


def test_negatives_of_large_numbers(spark):
    rows = [(i, [1e6 + i, 1e7 - 3 * i, 1e5 * (i % 3)], i % 2) for i in range(0, 300, 25)]
    rows = [(i, [float(brute.struct.unpack("f", brute.struct.pack("f", x))[0]) for x in v], label) for i, v, label in rows]
    assert as_set(negatives.report(vectors(spark, rows)).collect()) == as_set(brute.hard_negatives(rows))


def test_negatives_other_limits(spark):
    rows = [(i, [1.0 - i / 1000, 0.1], i % 3) for i in range(0, 101)]
    ready = negatives.prepared(vectors(spark, rows))
    found = negatives.hard_negatives(ready, F.col("id") == 0, positives=2, negatives=3, lowest=90, highest=98).collect()
    assert found and all(90 * r["positive_score"] <= 100 * r["negative_score"] <= 98 * r["positive_score"] for r in found)
    assert {(r["positive_id"], r["rank"]) for r in found} == {(p, k) for p in (3, 6) for k in (1, 2, 3)}


# Personal data

PII = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_personal_data(docs, rows):
    assert as_set(pii.report(docs).select(*PII).collect()) == as_set(brute.personal_data(rows))


TEXTS = [(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b@c.d"), (3, "a@b@c.d"), (4, "@b.c@d.e x@y.z_w@q.r"), (5, "1.2.3.4.5.6.7.8.9 256.1.1.1 1.2.3"),
         (6, "4111 1111-1111 1111 and 41111111111111111111 and 7-7"), (7, "+1 (017) 555-7713 +12 34567890123456 +1-- +4"),
         (8, "é② x.y%+z-@mail.ex-ample.co.uk. 010.0.0.1"), (9, "9" * 30_000), (10, "a." * 30_000), (11, "+1" * 9000), (12, "1." * 30_000),
         (13, "@a" * 20_000), (14, "x@y." * 9000), (15, "1 " * 20_000 + "4111111111111111"), (16, "0" * 6000 + "1.2.3.4")]


def test_personal_data_odd(spark):
    start = time.time()
    short = [(d, t) for d, t in TEXTS if len(t or "") < 6000]
    assert as_set(pii.report(frame(spark, short)).select(*PII).collect()) == as_set(brute.personal_data(short))
    assert pii.report(frame(spark, TEXTS)).count() == len(TEXTS)
    assert time.time() - start < 60
    assert pii.report(frame(spark, [])).count() == 0
    assert pii.spans_of("0" * 6000 + "1.2.3.4")[0][0] == "ip"
    covered = pii.mask(frame(spark, [(1, "write a@b.cd or 1.2.3.4 now"), (2, None)]))
    assert covered.columns == frame(spark, []).columns
    assert sorted(map(str, (r["text"] for r in covered.collect()))) == ["None", "write [EMAIL] or [IP] now"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1290.@+- ()_é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s[:3] for s in pii.spans_of(text) if s[4]] == brute.base_spans(text)


@pytest.mark.parametrize("text, added", [
    ("My IBAN is DE89 3704 0044 0532 0130 00, thanks.", ["iban"]),
    ("GB82WEST12345698765432", ["iban"]), ("GB82WEST12345698765433", []),
    ("ssn: 123-45-6789", ["ssn"]), ("part 123-45-6789", []), ("ssn 666-45-6789", []),
    ("call me: (555) 123-4567", ["tel"]), ("score 555 123 4567", []), ("order phoneless 555 123 4567", []),
    ("amex 378282246310005", ["short_card"]), ("number 378282246310005", []), ("amex 378282246310006", []),
    ("5555555555554445 4111111111111111", ["card"]), ("5555 5555 5555 4445 4111 1111 1111 1111", ["card"]),
    ("invoice 5555555555554445 4111111111111111", []),
])
def test_added_spans(text, added):
    assert [s[0] for s in pii.spans_of(text) if not s[4]] == added
    assert all(s[3] >= pii.THRESHOLD for s in pii.spans_of(text) if not s[4])


def test_context_moves_scores():
    plain, near, other = (pii.spans_of(f"{w} 1.2.3.4")[0][3] for w in ("see", "server", "version"))
    assert other < plain < near


def test_scores_follow_spans(spark):
    row = pii.report(frame(spark, [(1, "call +1 (017) 555-7713 or a@b.cd")])).first()
    assert row["spans"].count(",") == 1 and len(row["scores"]) == 2 and row["spans"].startswith("email:")


def test_queries_are_registered():
    assert {"op11_fill_in_middle", "op12_hard_negatives", "op13_personal_data"} <= set(queries.QUERIES)
