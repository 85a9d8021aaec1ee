import hashlib
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, elias_fano, exact_dedup, langid, lm, mixing, ngram_join, suffix_dedup, token_count, url_filter, warc
from ledgerlens.llm.elias_fano import Sequence, encode

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, _row int, kept string"


def _text(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Ordinary, empty, null, very long, repeated and nearly repeated documents."""
    r = random.Random(7)
    out = [_text(r, r.randint(1, 120)) for _ in range(60)]
    base = _text(r, 90).split()
    for _ in range(40):  # one large group of near copies
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = _text(r, 1, "xyz")
        out.append(" ".join(w))
    passage = _text(r, 70)
    out += [f"{_text(r, 30)} {passage} {_text(r, 30)}" for _ in range(12)]
    out += [out[3]] * 5 + [out[4].upper(), out[4] + " ", out[5].replace(" ", "\n\t")]
    out += [None, "", "   \n", "a", "ab cd", "é ü ñ 漢字 €", "12 34 !!", _text(r, 6000), "la " * 900, "la " * 900, "x" * 3000]
    return [(i, t) for i, t in enumerate(out)]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, ["s1", "s2", None][(i or 0) % 3], 1, "x") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    d = _docs(spark, rows).cache()
    d.count()
    return d


def _got(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_exact(docs, rows):
    got = exact_dedup.exact_groups(docs)
    assert _got(got.select("doc_id", "keep_id", "group_size", "text_sha256")) == sorted(brute.exact(rows), key=repr)
    assert got.where("kept <> (doc_id = keep_id)").isEmpty()
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {k for _, k, _, _ in brute.exact(rows)}


def test_exact_survives_hash_collisions(docs, rows):
    weak = lambda text: F.substring(F.unhex(F.md5(text)), 1, 1)
    got = exact_dedup.exact_groups(docs, digest=weak)
    assert _got(got.select("doc_id", "keep_id", "group_size", "text_sha256")) == sorted(brute.exact(rows), key=repr)


def test_exact_repeated_rows_and_null_ids(spark):
    d = _docs(spark, [(1, "a b"), (1, "a b"), (None, "ab"), (None, None), (None, ""), (2, "c"), (2, "c")])
    got = exact_dedup.exact_groups(d)
    assert got.count() == 7 and got.where("kept").count() == 3
    assert sorted((str(x.doc_id), x.text) for x in exact_dedup.exact_dedup(d).collect()) == [("1", "a b"), ("2", "c"), ("None", None)] or \
        sorted((str(x.doc_id), x.text) for x in exact_dedup.exact_dedup(d).collect()) == [("1", "a b"), ("2", "c"), ("None", "")]


def test_mix(spark, docs, rows):
    got = {x.doc_id: x for x in mixing.mix_sources(docs).collect()}
    size = {i: len(brute.SPACED.findall(t or "")) for i, t in rows}
    assert {i: x.size for i, x in got.items()} == size
    by = {}
    for i, _ in rows:
        by.setdefault(["s1", "s2", None][i % 3], []).append(i)
    total = sum(size.values())
    assert abs(sum(got[v[0]].target for v in by.values()) - 1.5 * total) < 1e-6
    for ids in by.values():
        s = sum(size[i] for i in ids)
        assert all(got[i].source_size == s and got[i].taken <= 2 * size[i] for i in ids)
        assert abs(sum(got[i].taken for i in ids) - got[ids[0]].target) <= max(size[i] for i in ids) / 2
    again = mixing.mix_sources(docs.repartition(3))
    assert _got(again) == _got(mixing.mix_sources(docs))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == [*docs.columns, "mix_size", "mix_target", "mix_taken"]
    assert {(x.doc_id, x.mix_taken) for x in mixed.collect()} == {(i, x.taken) for i, x in got.items() if x.taken}


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 10), (7, 2**40), (1000, 5000), (5000, 2**63), (300, 300)):
        v = np.sort(r.integers(0, top, n, dtype=np.uint64))
        s = Sequence(encode(v, top))
        assert (s.access(np.arange(n)) == v).all()
        before, after = s.pairs(np.arange(n - 1))
        assert (before == v[:-1]).all() and (after == v[1:]).all()
        x = np.concatenate([v, r.integers(0, top, 500, dtype=np.uint64)])
        assert (s.successor(x) == np.searchsorted(v, x)).all()
        at = s.find(x)
        assert ((at >= 0) == np.isin(x, v)).all() and (v[at[at >= 0]] == x[at >= 0]).all()


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm(docs, rows, order, monkeypatch):
    monkeypatch.setattr(lm, "PART", 4000)  # several parts
    monkeypatch.setattr(lm, "WORDS_PART", 20_000)
    monkeypatch.setattr(lm, "HELD", 3000)
    got = {x.doc_id: x for x in lm.score_held_out(docs, order=order).collect()}
    learn = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    for (i, _), (tokens, known, train, base, full) in zip(rows, brute.ngram_scores(rows, learn, order, lm.PRIORS), strict=True):
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (tokens, known, train, i not in learn)
        assert abs(g.base_score - base) < 1e-6 * tokens and abs(g.score - full) < 1e-3 * tokens


def test_lm_of_many_files(docs, rows, monkeypatch):
    """More model files than a worker keeps mapped: the same scores."""
    monkeypatch.setattr(lm, "PART", 12)
    monkeypatch.setattr(lm, "WORDS_PART", 3000)
    files = lm.train(docs)
    assert files.parts > 700 and files.words > 5 and files.parts > elias_fano.OPEN
    got = {x.doc_id: x for x in lm.score(docs, files).collect()}
    for (i, _), (tokens, _, _, base, full) in zip(rows, brute.ngram_scores(rows, {i for i, _ in rows}, lm.ORDER, lm.PRIORS), strict=True):
        assert got[i].n_tokens == tokens and abs(got[i].base_score - base) < 1e-6 * tokens and abs(got[i].score - full) < 1e-3 * tokens


def test_lm_files_are_opened_by_one_task(spark, docs, monkeypatch):
    """Look-ups go to the files of the model: no two workers map the same one, however many texts they score."""
    monkeypatch.setattr(lm, "PART", 500)
    monkeypatch.setattr(lm, "HELD", 3000)
    files = lm.train(docs)
    assert lm.score(docs, files).count() == docs.count()
    name = files.folder.rsplit("/", 1)[1]

    def mapped(batches):
        time.sleep(0.2)  # all workers take part
        with open("/proc/self/maps") as f:
            found = sorted({x.split("/")[-1].strip() for x in f if f"/{name}/grams-" in x})
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()] * len(found), pa.int64()), "file": pa.array(found, pa.string())})

    seen = {(x.pid, x.file) for x in spark.range(64).repartition(64).mapInArrow(mapped, "pid long, file string").collect()}
    assert files.parts > 20 and len(seen) > files.parts / 2 and len({f for _, f in seen}) == len(seen)


def test_lm_of_shared_words(spark):
    """Chunks of texts with nothing to learn, without a known word, and with the same n-grams at their edges."""
    rows = [(i, ("a b c d " * (i % 4)).strip() if i % 3 else f"w{i}") for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for folds, fold in ((7, 2), (1, 0), (2, 0)):
        learn = {i for i, _ in rows if zlib.crc32(str(i).encode()) % folds != fold}
        got = {x.doc_id: x for x in lm.score_held_out(d, folds=folds, fold=fold).collect()}
        for (i, _), (tokens, known, train, base, full) in zip(rows, brute.ngram_scores(rows, learn, lm.ORDER, lm.PRIORS), strict=True):
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (tokens, known, train)
            assert abs(got[i].base_score - base) < 1e-6 * tokens and abs(got[i].score - full) < 1e-6 * tokens


def test_lm_answers_of_few_and_many():
    """Look-ups one by one and by one scan of the trie give the same counts."""
    r = np.random.default_rng(3)
    files = lm.Files("", 1, 1, 1, 10**6, 400, 10, 3, lm.PRIORS)
    rows = np.unique(r.integers(0, 400, (6000, 3)) // r.integers(1, 60, (6000, 1)), axis=0).T
    n = r.integers(1, 9, rows.shape[1])
    part = lm.Part(lm._gram_arrays(list(rows), n, files), files)
    want = {}
    for row, c in zip(rows.T.tolist(), n.tolist(), strict=True):
        for k in (2, 3):
            want[tuple(row[:k])] = want.get(tuple(row[:k]), 0) + c
    ask = np.unique(np.c_[rows[:, ::2], r.integers(0, 400, (3, 500))], axis=1)
    for some in (ask, ask[:, 7:19]):
        two, three = part.counts(list(some))
        assert two.tolist() == [want.get(tuple(x[:2]), 0) for x in some.T.tolist()]
        assert three.tolist() == [want.get(tuple(x), 0) for x in some.T.tolist()]


def test_mapped_files_hold_no_descriptors(tmp_path):
    uris = [elias_fano.write_arrays(f"file://{tmp_path}", f"f{i}", {"x": np.array([i])}) for i in range(1500)]
    before = len(os.listdir("/proc/self/fd"))
    kept = elias_fano.Recent(elias_fano.map_arrays)
    assert [int(kept[u]["x"][0]) for u in uris] == list(range(1500))
    assert len(kept.held) == elias_fano.OPEN and len(os.listdir("/proc/self/fd")) <= before + 5
    with pytest.raises(FileNotFoundError):
        elias_fano.map_arrays(f"file://{tmp_path}/none")


def test_warc(spark):
    big = "<p>" + "é" * 200_000
    rows = [(3, "http://a/1", "x" * 100), (1, "u", "x" * 100), (2, None, "x" * 99), (4, "u\r\nv", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (None, "u", big), (9, "u", "line\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {x.page_id: tuple(x)[1:] for x in warc.archived(pages).collect()}
    want = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        same = min(j for j, _, g in rows if g == h and j is not None) if len(raw) >= 100 else i
        want[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if i == same else "revisit", None if i == same else same)
    assert got == want
    chunks = warc.read_warc(warc.write_warc(warc.plan_records(pages))).where("record_id = '<urn:x-page:7>'").orderBy("chunk_no").collect()
    assert len(chunks) > 5 and b"".join(x.data for x in chunks) == big.encode() and [x.last for x in chunks] == [False] * (len(chunks) - 1) + [True]
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_ids(spark):
    """Ids that would end a header line or a URI, the text null beside a null id, and long ones."""
    ids = ["a\r\nWARC-Type: x", "a>b", "<", "null", None, "", " ", "%", "%41", "A", "é+&/ x", "x" * 200_000]
    body = "z" * 300
    pages = spark.createDataFrame([(i, "u", body) for i in ids] + [(i, "u", "short") for i in ids], "page_id string, url string, html string").repartition(3)
    got = sorted((tuple(x) for x in warc.archived(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    least = min(i for i in ids if i is not None)
    want = [(i, 300, "response" if i == least else "revisit", None if i == least else least) for i in ids] + [(i, 5, "response", None) for i in ids]
    assert got == sorted(want, key=repr)


def test_urls(spark):
    from ledgerlens.llm.queries import RULES

    r = random.Random(3)
    hosts = ["com", "example.com", "a.example.com", "EXAMPLE.com", "notexample.com", "b.net", "example.net", "x.example.net", "w.org", "", "a..com"]
    rows = [(i, f"http://{r.choice(hosts)}{r.choice(['', '/', '?q', '#f', '/en/', '/en/7', '/en/71?x', '/de/8', '/de/', '/es/a/b#c'])}") for i in range(400)] + [(400, None), (401, "mailto:x"), (402, ""), (402, "ftp://h/p://q")]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)

    def judge(url):
        host = path = ""
        if url and "://" in url:
            import re

            host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
            host = host.translate(brute.LOW)
        fit = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: x.rank, default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    want = sorted(((i, *judge(u)) for i, u in rows), key=repr)
    assert _got(url_filter.judge_urls(pages, RULES)) == want
    assert _got(url_filter.judge_urls(pages, RULES, at_once=2)) == want
    assert {x.verdict for x in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_url_rules_of_the_contract(spark):
    """The contract's list, spelled out, on hosts with control characters: NUL ends no label."""
    from ledgerlens.llm.queries import RULES

    listed = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    assert [(x.verdict, x.host, x.path) for x in RULES] == listed
    hosts = ["com", "com\x00x", "example.com\x00x", "x\x00com", "a.com\x00", "x\x00.com", "example.com", "x.example.com", "net\x00", "example.net\x01", "example.net", "org\x00.org", ".org", "org."]
    urls = [f"http://{h}{p}" for h in hosts for p in ("/en/", "/en/7", "/de/", "/de/81", "/es/")]

    def judge(url):
        host, path = url[7:].split("/", 1)
        fit = [(len(h + p), h + p, v) for v, h, p in listed if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        return max(fit)[1:] if fit else (None, "allow")

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    assert _got(url_filter.judge_urls(pages, RULES).select("page_id", "rule", "verdict")) == sorted(((i, *judge(u)) for i, u in enumerate(urls)), key=repr)


def test_decontaminate(spark, docs, rows):
    r = random.Random(5)
    items = [(k, " ".join(brute.ALNUM.findall(rows[k][1])[:r.randint(1, 14)])) for k in range(0, 50, 7)] + [(98, None), (99, ""), (None, rows[70][1]), (5, "zz, Zz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contaminated(rows, items), key=repr)
    assert _got(decontaminate.contamination(docs, bench)) == want
    assert _got(decontaminate.contamination(docs, bench, at_once=200)) == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {x[0] for x in want if not x[-1]}
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated or n_words = 0").count() == sum(x[1] == 0 for x in want)


def test_tokens(docs, rows):
    from tokenizers import Tokenizer, models

    v = token_count.read_vocabulary()
    low = min(v.scores.values())
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{i:02X}>", low) for i in range(256)), *v.scores.items()], 0, byte_fallback=True))
    for x in token_count.token_counts(docs, v).collect():
        w = brute.SPACED.findall(dict(rows)[x.doc_id] or "")
        assert (x.n_words, x.n_tokens) == (len(w), sum(len(t.encode(token_count.MARK + p).tokens) for p in w))


@pytest.mark.parametrize(("length", "frequent"), [(400, 2000), (40, 2000), (40, 3)])
def test_repeats(docs, rows, length, frequent):
    assert _got(suffix_dedup.remove_repeats(docs, length=length, frequent=frequent)) == sorted(brute.repeats(rows, length), key=repr)


def test_short_repeats(docs, rows):
    got = {x.doc_id: x.n_short for x in suffix_dedup.remove_repeats(docs, length=100, short=40).collect()}
    assert got == {x[0]: x[2] for x in brute.repeats(rows, 40)}


def test_repeats_in_many_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ANCHORS", 500)
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", 20_000)
    for frequent in (2000, 3):
        assert _got(suffix_dedup.remove_repeats(docs, length=40, frequent=frequent)) == sorted(brute.repeats(rows, 40), key=repr)


def test_a_passage_of_very_many_texts(spark):
    """Equal contents of a task are one entry of its run, and all places learn what was found."""
    licence, entries = _text(random.Random(1), 300)[:1200], []
    for n in (150, 600):
        r = random.Random(n)
        # the passage between surroundings that texts share in groups of ten, so that edges repeat too
        docs = spark.createDataFrame([(i, f"{_text(random.Random(i // 10), 60)} {licence} {_text(random.Random(-i // 10), 60)}" + _text(r, 90), None, None, 1, "x") for i in range(n)], SCHEMA).coalesce(1)
        base = suffix_dedup._base(docs, "doc_id", "text")
        texts = suffix_dedup.anchored_texts(docs, base, "doc_id", "text", 400, 100, 50)
        runs = texts.coalesce(1).mapInArrow(lambda b: suffix_dedup._run_batches(b, 64, 400, 100), suffix_dedup._RUN)
        found = runs.agg(F.sum(F.when(F.col("part") >= 0, F.octet_length("names") / 16)).alias("n"), F.sum(F.when(F.col("part") < 0, F.octet_length("starts") / 8)).alias("places")).first()
        entries.append(found.n / found.places)
        out = suffix_dedup.remove_repeats(docs, frequent=50)
        assert out.where("n_removed < 1200").isEmpty() and out.count() == n
    assert entries[1] < entries[0] < 0.5  # the more texts, the fewer entries a place


def test_repeats_of_repeated_rows(spark):
    d = [(1, "ab" * 300), (1, "ab" * 300), (None, "q" * 50), (2, None)]
    assert _got(suffix_dedup.remove_repeats(_docs(spark, d), length=40)) == sorted(brute.repeats(d, 40), key=repr)


def test_loser_tree():
    r = random.Random(2)
    runs, every = [], []
    for _ in range(7):
        run = sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 30)))
        every += run
        runs.append([(suffix_dedup._common(a, b, 0), b, None) for a, b in zip([b"", *run], run, strict=False)])
    got = list(suffix_dedup.LoserTree(runs))
    assert [w for _, w, _ in got] == sorted(every)
    assert [n for n, _, _ in got[1:]] == [suffix_dedup._common(a[1], b[1], 0) for a, b in zip(got, got[1:], strict=False)]


def test_language(spark):
    r = random.Random(11)
    kinds = {"aa": "abcde", "bb": "efghij", "cc": "klmné"}
    d = [(i, _text(r, 30, kinds[k]), k) for i in range(150) for k in [list(kinds)[i % 3]]] + [(150, None, "aa"), (151, "12 !", "bb"), (152, "", None), (153, "klm", None)]
    docs = spark.createDataFrame(d, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(docs).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in d)
    assert all(got[i].lang_pred == k for i, _, k in d[:150])
    assert [got[i].lang_pred for i in (150, 151, 152, 153)] == ["und", "und", "und", "cc"]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.doc_id for x in langid.keep_identified(docs).collect()} == {i for i, _, _ in d} - {150, 151, 152}
    p = langid.train_profiles(docs)
    one, two = langid.predict(docs, p).collect(), langid.predict(docs, p, at_once=1).collect()
    assert sorted((x.doc_id, x.lang_pred, x.score) for x in one) == sorted((x.doc_id, x.lang_pred, x.score) for x in two)
    want = brute.languages(d, {i for i, _, _ in d if zlib.crc32(str(i).encode()) % 3 != 1})
    assert [(i, k) for i, k, _ in want] == [(i, got[i].lang_pred) for i, _, _ in d] and all(abs(got[i].score - s) < 1e-9 for i, _, s in want)
    again = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(docs.repartition(7)).collect()}
    assert again == {i: (x.lang_pred, x.score) for i, x in got.items()}  # whatever the partitions
    assert {x.doc_id for x in langid.keep_identified(docs, languages=("aa",)).collect()} == {i for i, _, k in d[:150] if k == "aa"}
    mixed = docs.limit(90).unionByName(docs.limit(1).select(F.lit(999).cast("long").alias("doc_id"), F.lit("жук щука " * 30).alias("text"), F.lit(None).cast("string").alias("lang")))
    assert 999 not in {x.doc_id for x in langid.keep_identified(mixed).collect()}
    assert langid.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [1000, 8])
def test_near(docs, rows, group):
    assert _got(ngram_join.join_ngrams(docs, group=group)) == sorted(brute.near(rows), key=repr)


def test_near_in_many_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK", 3000)
    assert _got(ngram_join.join_ngrams(docs, group=20)) == sorted(brute.near(rows), key=repr)


def test_near_names_that_meet(docs, rows):
    """First names of 8 bits, which most sets share: the same components."""
    want = sorted(brute.near(rows), key=repr)
    for bits in (1, 8):
        assert _got(ngram_join.join_ngrams(docs, bits=bits)) == want
    _, names = ngram_join._classes(docs, "doc_id", "text", 8)
    assert len(names.taken) > 5


def test_near_chain(spark, monkeypatch):
    """A chain of sets, each linked with its neighbours alone, is one group; what is compared grows about as the chain does."""
    compared, plain = [], ngram_join._near

    def counting(*args):
        out = plain(*args)
        compared.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_near", counting)
    for n in (1250, 5000):
        words = [f"w{k}" for k in range(3 * n + 60)]
        d = spark.createDataFrame([(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(n)], "doc_id long, text string").repartition(8)
        assert {x.component_id for x in ngram_join.join_ngrams(d, group=100).collect()} == {0}
    assert compared[1] <= 6 * compared[0], compared


def test_near_keeps_one_of_each(spark, docs, rows):
    want = {c if n else i for i, n, c in brute.near(rows)}
    kept = ngram_join.dedup_ngrams(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(want)
    d = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (2, None), (None, "")]
    assert ngram_join.dedup_ngrams(_docs(spark, d)).count() == 3


def test_very_long_texts(spark):
    r = random.Random(13)
    long = _text(r, 40_000)
    rows = [(1, long), (2, long[:-3] + "zzz"), (3, "y" * 1_000_000), (4, None), (5, "a b c"), (6, "klm " + long[1000:1500])]
    d = _docs(spark, rows)
    items = [(1, " ".join(long.split()[500:515])), (2, "y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert _got(decontaminate.contamination(d, bench)) == sorted(brute.contaminated(rows, items), key=repr)
    assert _got(ngram_join.join_ngrams(d)) == sorted(brute.near(rows), key=repr)
    assert {x.doc_id: x.size for x in mixing.mix_sources(d).collect()} == {i: len(brute.SPACED.findall(t or "")) for i, t in rows}
    assert _got(exact_dedup.exact_groups(d).select("doc_id", "keep_id", "group_size", "text_sha256")) == sorted(brute.exact(rows), key=repr)
    v = token_count.read_vocabulary()
    counts = {x.doc_id: (x.n_words, x.n_tokens) for x in token_count.token_counts(d, v).collect()}
    one = {k: x for k, x in v.scores.items() if set(k) <= {"y", token_count.MARK}}  # the pieces that a word of one letter can have
    assert counts.pop(3) == (1, brute.token_count(token_count.MARK + "y" * 1_000_000, one, v.unknown))
    known = {x: brute.token_count(token_count.MARK + x, v.scores, v.unknown) for x in {w for i, t in rows if i != 3 for w in brute.SPACED.findall(t or "")}}
    assert counts == {i: (len(w), sum(map(known.get, w))) for i, w in ((i, brute.SPACED.findall(t or "")) for i, t in rows if i != 3)}
    learn = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    scores = {x.doc_id: x for x in lm.score_held_out(d).collect()}
    for (i, _), (tokens, known, _, base, full) in zip(rows, brute.ngram_scores(rows, learn, lm.ORDER, lm.PRIORS), strict=True):
        assert (scores[i].n_tokens, scores[i].n_known) == (tokens, known)
        assert abs(scores[i].base_score - base) < 1e-6 * tokens and abs(scores[i].score - full) < 1e-3 * tokens
    same = [x for x in brute.repeats([x for x in rows if x[0] != 3], 400)] + [(3, 1_000_000, 1_000_000, 1, hashlib.sha256(b"").hexdigest())]
    assert _got(suffix_dedup.remove_repeats(d)) == sorted(same, key=repr)
    found = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(d).collect()}
    for i, lang, score in brute.languages([(i, t, "en" if i % 2 else None) for i, t in rows], {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}):
        assert found[i][0] == lang and abs(found[i][1] - score) < 1e-9


def test_empty_tables(spark, docs, tmp_path):
    import corpus_pipeline

    none, bench = docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for f in (exact_dedup.exact_groups, exact_dedup.exact_dedup, mixing.mix_sources, mixing.mix_documents, lm.score_held_out, token_count.token_counts,
              suffix_dedup.remove_repeats, ngram_join.join_ngrams, ngram_join.dedup_ngrams, langid.identify, langid.keep_identified):
        assert f(none).count() == 0, f
    assert decontaminate.contamination(none, bench).count() == 0 and decontaminate.decontaminate(none, bench).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(pages, [url_filter.Rule("block", "com", "/")]).count() == 0 and warc.archived(pages).count() == 0
    none.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, docs, rows):
    """Extra columns with the names that the operators use inside, or return."""
    names = {"lang": "n_words", "source": "_id", "_row": "hit_spans", "kept": "_text"}
    d, items = docs.withColumnsRenamed(names), [(1, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("_item", F.lit("x"))
    for at_once in (8_000_000, 50):
        assert _got(decontaminate.contamination(d, bench, at_once=at_once)) == sorted(brute.contaminated(rows, items), key=repr)
        assert decontaminate.decontaminate(d, bench, at_once=at_once).columns == d.columns
    pages = spark.createDataFrame([(1, "http://a.com/x", "x" * 200), (2, "http://b.net/x", "x" * 200)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("?") for c in ("payload", "digest", "kind", "first", "host", "path", "_key", "_rank", "rule", "verdict")})
    assert _got(warc.archived(pages).select("page_id", "record_type", "refers_to")) == [(1, "response", None), (2, "revisit", 1)]
    assert _got(url_filter.judge_urls(pages, [url_filter.Rule("block", "com", "/")]).select("page_id", "rule", "verdict")) == [(1, "com/", "block"), (2, None, "allow")]
    hidden = docs.select("doc_id", "text", "lang", F.lit("?").alias("lang_pred"), F.lit(1).alias("_best"), F.lit(1).alias("_p"))
    assert langid.keep_identified(hidden).columns == hidden.columns


def test_hot_payload(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("p" * 500)).when(F.col("id") % 3 == 1, F.lit("")).otherwise(
        F.concat(F.lit("q" * 120), F.col("id"))).alias("html")).repartition(6)
    got = warc.archived(pages)
    assert got.count() == 3000 and got.where("record_type = 'revisit'").count() == 999 and got.where("refers_to = 0").count() == 999
    assert got.where("record_type = 'revisit' and payload_bytes <> 500").isEmpty()


def test_null_ids_and_clashing_columns(spark):
    d = spark.createDataFrame([(None, "a b c", None, None, 1, "x"), (None, None, "en", "s", None, None), (1, "", "en", "s", 2, "y"), (1, "a b c", "en", "s", 2, "y")],
                              SCHEMA).withColumnsRenamed({"_row": "sig", "kept": "_text"})
    for f in (exact_dedup.exact_groups, mixing.mix_sources, lm.score_held_out, token_count.token_counts, suffix_dedup.remove_repeats, ngram_join.join_ngrams, langid.identify):
        assert f(d).count() == 4, f
    for f in (exact_dedup.exact_dedup, ngram_join.dedup_ngrams, langid.keep_identified):
        assert f(d).columns == d.columns, f
    assert mixing.mix_documents(d).columns[:6] == d.columns
