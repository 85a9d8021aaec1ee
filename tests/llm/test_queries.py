"""The registered queries, and the pipeline, against plain versions on the smallest tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ledgerlens.llm import langid, lm, token_count

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def _run(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


def _got(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_repeats(spark, rows):
    out = _run(spark, "op8_suffix_dedup").cache()
    assert _got(out.drop("n_short")) == sorted(brute.repeats(rows, 400), key=repr)
    assert {r.doc_id: r.n_short for r in out.collect()} == {x[0]: x[2] for x in brute.repeats(rows, 200)}


def test_near(spark, rows):
    assert _got(_run(spark, "op10_ngram_join")) == sorted(brute.near(rows), key=repr)


def test_scores(spark, rows):
    learn = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    got = {r.doc_id: r for r in _run(spark, "op3_lm_score").collect()}
    held = base = 0.0
    for (i, _), (tokens, known, train, one, full) in zip(rows, brute.ngram_scores(rows, learn, lm.ORDER, lm.PRIORS), strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, train)
        assert abs(r.base_score - one) < 1e-6 * tokens and abs(r.score - full) < 1e-3 * tokens
        held, base = held + r.held_out * r.score, base + r.held_out * r.base_score
    two = sum(x[4] for (i, _), x in zip(rows, brute.ngram_scores(rows, learn, 2, lm.PRIORS), strict=True) if i not in learn)
    assert held > two > base  # longer contexts help on texts that were not learned


def test_tokens(spark, rows):
    v, texts, known = token_count.read_vocabulary(), dict(rows), {}
    for r in _run(spark, "op7_token_counts").collect():
        w = brute.SPACED.findall(texts[r.doc_id])
        for x in set(w) - set(known):
            known[x] = brute.token_count(token_count.MARK + x, v.scores, v.unknown)
        assert (r.n_words, r.n_tokens) == (len(w), sum(known[x] for x in w))


def test_language(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = {r.doc_id: r for r in _run(spark, "op9_language").collect()}
    want = brute.languages(rows, {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1})
    assert len(out) == len(rows)
    for i, lang, score in want:
        assert out[i].lang_pred == lang and abs(out[i].score - score) < 1e-9 and out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [(out[i].lang_pred, lang) for i, _, lang in rows if out[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def _mixed(docs):
    """doc_id -> words taken, of (doc_id, source, words)."""
    weight, taken = [5.0, 2.0, 1.0], {}
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(w for _, x, w in docs if x == s) for s in sources}
    w = {s: weight[k % 3] for k, s in enumerate(sources)}
    full = set()
    while True:
        free = [s for s in sources if s not in full]
        share = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(w[s] for s in free) if free else 0
        more = {s for s in free if share * w[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in sources:
        target = 2.0 * size[s] if s in full else share * w[s]
        times = int(target // size[s]) if size[s] else 0
        need, upto = target - times * size[s], 0
        order = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, n) for i, x, n in docs if x == s)
        for _, i, n in order:
            taken[i] = n * (times + (upto + n / 2 <= need))
            upto += n
    return taken


def test_pipeline(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    found = brute.languages(rows, {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1})
    known = {i for i, lang, score in found if lang != "und" and score >= langid.LEAST}
    docs = [d for d in docs if d[0] in known]
    stay = {k for _, k, _, _ in brute.exact([d[:2] for d in docs])}
    docs = [d for d in docs if d[0] in stay]
    stay = {c if n else i for i, n, c in brute.near([d[:2] for d in docs])}
    docs = [d for d in docs if d[0] in stay]
    bad = {x[0] for x in brute.contaminated([d[:2] for d in docs], items) if x[-1]}
    docs = [d for d in docs if d[0] not in bad]
    want = {i: n for i, n in _mixed([(i, s, len(brute.SPACED.findall(t))) for i, t, s in docs]).items() if n}
    assert bad and len(want) > 50
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.mix_taken for r in out.collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]


OTHERS = {  # the first article of the declaration of human rights, in languages that share letters with those that are learned
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. ",
    "cy": "Genir pawb yn rhydd ac yn gydradd a'i gilydd mewn urddas a hawliau. Fe'u cynysgaeddir a rheswm a chydwybod, a dylai pawb ymddwyn y naill at y llall mewn ysbryd cymodlon. "}


def test_pipeline_rejects_languages_in_the_same_letters(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    row = docs.limit(1)
    strange = [row.withColumns({"doc_id": F.lit(1_000_000 + i).cast(docs.schema["doc_id"].dataType), "text": F.lit(t * 6), "lang": F.lit(None).cast("string")}) for i, t in enumerate(OTHERS.values())]
    every = docs.unionByName(strange[0]).unionByName(strange[1]).unionByName(strange[2])
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, every, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}  # these go, and no others
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("fr", "es"))
    some = corpus_pipeline.identify_language(spark, every, SF)
    found = {r.lang: r["count"] for r in some.groupBy("lang").count().collect()}
    have = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert some.columns == docs.columns and found["fr"] >= 0.95 * have["fr"] and found["es"] >= 0.95 * have["es"] and found.get("en", 0) <= 0.02 * have["en"]


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, clashing names, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    none = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    odd = docs.limit(2).withColumn("text", F.lit("")).unionByName(none).unionByName(docs.limit(3)).unionByName(docs)
    odd = odd.withColumns({"score": F.lit(1), "lang_pred": F.lit("x"), "kept": F.lit(True), "_row": F.lit(2)})
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    odd.coalesce(3).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert len({r.doc_id for r in out}) == len(out) > 20 and all(r.text for r in out)
    (tmp_path / "b").mkdir()
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    odd.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_pipeline_rejects_other_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    strange = docs.limit(3).withColumns({"doc_id": docs.doc_id + 1_000_000, "text": F.lit("съешь ещё этих мягких французских булок да выпей чаю " * 20), "lang": F.lit(None).cast("string")})
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(strange), SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not any(i >= 1_000_000 for i in ids) and len(ids) > 100
