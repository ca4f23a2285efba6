"""Rows keep an identity of their own whatever frame they come from."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspar.llm import common, context_mixing, cotraining, decontamination, licenses, line_rules, near_dedup, repeats

DDL = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.fixture
def frames(spark, table):
    """The same 40 documents, as a plain scan and made by explode and by a join from 20 file rows."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    same = " ".join(rng.choices(words, k=90))
    own = [" ".join(rng.choices(words, k=90)) for _ in range(20)]
    plain = table([(2 * i + j, (same, own[i])[j], "s", "en", 5) for i in range(20) for j in range(2)], DDL, "plain")
    halves = table([(i, [(2 * i, same), (2 * i + 1, own[i])]) for i in range(20)], "k long, parts array<struct<doc_id:long,text:string>>", "halves")
    rest = [F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(5).cast("long").alias("n_chars")]
    exploded = halves.select(F.explode("parts").alias("p")).select("p.doc_id", "p.text", *rest)
    left = table([(i, own[i]) for i in range(20)], "k long, own string", "left")
    joined = left.crossJoin(F.broadcast(spark.createDataFrame([(0,), (1,)], "j int"))).select((F.col("k") * 2 + F.col("j")).alias("doc_id"), F.when(F.col("j") == 0, same).otherwise(F.col("own")).alias("text"), *rest)
    return plain, {"explode": exploded, "join": joined}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_what_is_a_scan(table):
    docs = table([(i, f"a {i}", "s", "en", 1) for i in range(30)], DDL)
    assert common.is_scan(docs) and common.is_scan(docs.filter("doc_id > 3").select("text", F.upper("source").alias("source"))) and common.is_scan(docs.alias("d"))
    for other in (docs.limit(5), docs.orderBy("doc_id").limit(5), docs.filter(F.rand() < 0.5), docs.withColumn("r", F.rand()), docs.sample(0.5), docs.dropDuplicates(["lang"]), docs.distinct(), docs.union(docs), docs.join(docs.select("doc_id"), "doc_id"), docs.groupBy("doc_id").agg(F.first("text").alias("text")), docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), docs.repartition(3), docs.withColumn("n", F.monotonically_increasing_id())):
        assert not common.is_scan(other)
        kept = common.located(other, ["text"])
        assert kept.select("_file", "_block", "_row").distinct().count() == kept.count() > 0


@pytest.mark.parametrize("made", ["explode", "join"])
def test_operators_on_frames_that_are_no_scans(frames, table, made):
    plain, others = frames
    other = others[made]
    assert near_dedup.distinct_documents(other).count() == 21
    assert rows(near_dedup.link(other, 3, 85).select("doc_id", "component_id")) == rows(near_dedup.link(plain, 3, 85).select("doc_id", "component_id"))
    assert rows(repeats.strip(other)) == rows(repeats.strip(plain))
    assert rows(repeats.find(other).select("doc_id", "kept_sha256")) == rows(repeats.find(plain).select("doc_id", "kept_sha256"))
    assert rows(line_rules.clean(other)) == rows(line_rules.clean(plain))
    assert rows(line_rules.judge(other).select("doc_id", "removed_words", "kept")) == rows(line_rules.judge(plain).select("doc_id", "removed_words", "kept"))
    item = table([(1, plain.filter("doc_id = 7").first().text)], "item_id long, text string", "bench")
    assert rows(decontamination.decontaminate(other, item)) == rows(plain.filter("doc_id <> 7"))


@pytest.mark.parametrize("made", ["explode", "join"])
def test_models_on_frames_that_are_no_scans(frames, table, made):
    other = frames[1][made]
    labels = table([(i, i % 2, 0) for i in range(0, 40, 3)], "doc_id long, quality int, toxic int", "labels")
    assert cotraining.score(other, labels).select("doc_id").distinct().count() == 40
    assert sorted(r.doc_id for r in context_mixing.score(other).select("doc_id").collect()) == list(range(40))


@pytest.mark.parametrize("kept", ["limit", "rand", "sample", "first"])
def test_passes_see_the_same_rows(frames, kept):
    plain, _ = frames
    frame = {"limit": plain.limit(15), "rand": plain.filter(F.rand() < 0.5), "sample": plain.sample(0.5), "first": plain.dropDuplicates(["text"])}[kept]
    out = line_rules.clean(frame).collect() + near_dedup.distinct_documents(frame).collect() + repeats.strip(frame).collect()
    assert all(r.text is not None and r.doc_id is not None for r in out)
    assert all(n == 1 for n in Counter(r.doc_id for r in repeats.strip(frame).collect()).values())


#: Characters that Python takes for space and the contract doesn't.
SPACES = "\u0085\u00a0\u1680\u2000\u2003\u2028\u2029\u202f\u205f\u3000"


@pytest.mark.parametrize("space", SPACES)
def test_license_words_hold_spaces_beyond_ascii(table, space):
    texts = [f"cc by{space}x then by cc", f"all rights reserved{space}inc and reserved", f"{space}cc by", f"cc{space}by", f"a cc by {space} b", f"licensed under the apache license{space} version 2.0", "cc by"]
    got = {r.doc_id: r for r in licenses.scan(table(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_base for i in range(7)] == [0, 0, 0, 0, 1, 0, 1]
    assert got[4].n_words == 5 and got[3].n_words == 1 and got[0].base_labels == "" and "cc-by" not in got[0].labels
    assert "apache" not in got[5].labels or got[5].n_words == 7


def test_all_reordered_items_are_met():
    """Which pairs are tiled: every item that tiling of all pairs covers enough is among a text's candidates."""
    rng = random.Random(6)
    ids, texts, documents = [], [], []
    for k in range(60):
        width = rng.choice([3, 3, 4, 5, 7])
        item = [f"i{k}w{j}" for j in range(rng.choice([6, 12, 40, 41]))]
        pieces = [item[a : a + width] for a in range(0, len(item), width)]
        rng.shuffle(pieces)
        documents.append(" ".join(" ".join(p) + f" x{rng.randrange(99)}" for p in pieces))
        ids.append(k)
        texts.append(" ".join(item))
    block = decontamination.Block(ids, texts)
    words = common.Words(common.plain_words(pa.array(documents)), lower=False)
    found = block.candidates(words.hashes(), words.starts)
    covered = 0
    for d in range(60):
        text = words.hashes()[words.starts[d] : words.starts[d + 1]]
        for k in range(60):
            if decontamination.tile(block.tokens[k], text) >= 0.8 * len(block.tokens[k]):
                covered += 1
                assert k in found.get(d, set())
    assert covered > 40
