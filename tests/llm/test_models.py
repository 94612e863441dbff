"""Quality rules, toxicity, WARC archives, mixing and the pipeline on small corpora."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palindra.llm import mixing, quality, storage, suffix_dedup, toxicity, warc

from . import fixture


# ---- quality ------------------------------------------------------------------------------------


def brute_base(value):
    w = fixture.WORDS.findall(value or "")
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in (value or "").split("\n"):
        if fixture.WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", value or "")), dup, len(covered)


def test_base_rules(spark):
    extra = ["a b c d e a b c d e f", "x\nx\n\nx y", "# * | <b> é&", " ".join(["same"] * 30)]
    rows = fixture.corpus() + [(5000 + k, t, None, None, None, None, None) for k, t in enumerate(extra)]
    trees = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    got = quality.judged(fixture.frame(spark, rows), trees).collect()
    want = defaultdict(set)
    for i, value, *_ in rows:
        want[i].add(brute_base(value))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in want[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_trees_learn_and_are_monotone():
    r = np.random.default_rng(3)
    x = r.uniform(0, 1, (1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7) | (x[:, 2] > 0.9)).astype(float)
    trees = quality.fit(x, y, (0, 0, 1, -1), trees=80)
    assert ((trees.probability(x) > 0.5) == (y > 0.5)).mean() > 0.9
    base = r.uniform(0, 1, (200, 4))
    for feature, sign in ((2, 1), (3, -1)):
        last = None
        for v in np.linspace(0, 1, 40):
            moved = base.copy()
            moved[:, feature] = v
            now = trees.margin(moved) * sign
            assert last is None or (now >= last - 1e-9).all()
            last = now
    # flat arrays step like a walk from the root
    k = int(trees.roots[0])
    while trees.left[k]:
        k = int(trees.left[k] + (x[0, trees.feature[k]] > trees.cut[k]))
    one = quality.Trees(trees.feature, trees.cut, trees.left, trees.value, trees.roots[:1], 0.0)
    assert one.margin(x[:1])[0] == trees.value[k]


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.model(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judged(docs, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert sum((r.quality > 0) == r.kept for r in rows) / len(rows) > 0.95
    assert quality.judged(docs.limit(0), trees).count() == 0


# ---- toxicity -----------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("You 1D10T, сlown!") == " you idiot clown "
    assert toxicity.fold("naïve than*** 42 -- ") == " naive than "
    assert toxicity.fold("") == "  "


def test_lexicon_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " scum": 4.0}, ("idiot proof",))
    assert lexicon.features("an idiot proof lid")[0] == 0
    assert lexicon.features("an 1diot")[0] == 5 and lexicon.features("scummy idiot")[0] == 9
    assert toxicity.Lexicon({}).features("anything") == (0.0, 0.0)
    brute = lambda text: sum(w == "idiot" for w in toxicity.fold(text).split()) * 5 + sum(w.startswith("scum") for w in toxicity.fold(text).split()) * 4
    r = random.Random(2)
    for _ in range(200):
        text = " ".join(r.choice(["idiot", "scum", "scums", "idiots", "a", "1diot!"]) for _ in range(r.randint(0, 9)))
        assert lexicon.features(text)[0] == brute(text)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    terms, weights = toxicity.model(docs, labels)
    rows = toxicity.scored(docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").select("doc_id", "text", "toxic"), terms, weights).collect()
    said = [(r.toxic, r.score >= toxicity.THRESHOLD) for r in rows]
    hit = sum(t and s for t, s in said)
    assert hit / sum(t for t, _ in said) > 0.8 and sum(s and not t for t, s in said) / len(said) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)


#: Words that the driver's toxic documents use; the library holds no such list.
INSULTS = ("idiot", "scum", "clown", "loser", "moron", "pathetic", "trash", "disgusting", "worthless", "stupid")
_UNDONE = str.maketrans("0134578@$!|аеорсухіѕ", "oieastbasilaeopcyxis")


def holds_insult(value):
    """Whether a text has an insult as a word, disguised or not, by a scan of its own."""
    plain = re.sub(r"[^a-z]+", " ", (value or "").lower().translate(_UNDONE))
    return any(w in INSULTS for w in plain.split())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_finds_what_holds_an_insult(spark, sf):
    """Labels are on texts without any insult, too, which are noise: of those that hold one, nine in ten are found."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    terms, weights = toxicity.model(docs, labels)
    rows = toxicity.scored(docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").select("doc_id", "text", "toxic"), terms, weights).collect()
    real = [r for r in rows if r.toxic and holds_insult(r.text)]
    assert len(real) >= 10 and sum(r.score >= toxicity.THRESHOLD for r in real) >= 0.9 * len(real)
    assert sum(r.score >= toxicity.THRESHOLD for r in rows if not r.toxic) <= len(rows) // 500
    assert len({r.score for r in rows}) > 1


def test_few_labels_give_no_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = toxicity.scored(docs, *toxicity.model(docs, labels)).collect()
    assert not any(r.score >= toxicity.THRESHOLD for r in rows) and len(rows) == docs.count()


def test_both_readings_of_a_word():
    lexicon = toxicity.Lexicon({" shit ": 2.0, " idiot ": 3.0, " than ": 1.0}, ("idiot proof",))
    for text, want in (("5h17", 2), ("1d107", 3), ("an !d10t", 3), ("th4n", 1), ("than2", 1), ("1diot proof", 0), ("42 1007 !!", 0), ("5hip", 0)):
        assert lexicon.features(text)[0] == want, text
    assert toxicity.fold("1d107 no") == " d no "


def test_terms_and_exceptions_are_learnt(spark):
    r, words = random.Random(6), ["grass", "river", "stone", "cloud", "table", "green", "seven", "light"]
    rows = []
    for k in range(240):
        toxic = k % 4 == 0
        said = "blorg" if toxic else "blorg cheese" if k % 12 == 1 else "moron" if k % 4 == 2 else ""
        body = [r.choice(words) + str(r.randrange(40)) for _ in range(30)]
        rows.append((" ".join([*body[:9], said, *body[9:]]), int(toxic)))
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, label int"))
    assert terms[" blorg "] > 0 and [t for t, w in terms.items() if w is None] == [" blorg cheese "]
    assert " moron " not in terms and " idiot " not in terms  # no word counts without evidence
    lexicon = toxicity.Lexicon(terms)
    assert lexicon.features("a blorg cheese")[0] == 0 < lexicon.features("cheese blorg")[0]
    assert toxicity.learn_terms(spark.createDataFrame([], "text string, label int")) == {}


def test_exception_phrases_may_overlap():
    lexicon = toxicity.Lexicon({" a ": 1.0, " b ": 1.0, " c ": 1.0}, ("x a b", "b y", "c"))
    assert lexicon.features("x a b y a")[0] == 1 and lexicon.features("a b c")[0] == 2 and lexicon.features("c b y b")[0] == 1


def test_a_null_id_is_not_held_out(spark):
    got = spark.createDataFrame([(None,), (1,)], "doc_id long").select(toxicity.training_row(F.col("doc_id")).alias("x")).collect()
    assert got[0].x is True and got[1].x is not None


def test_toxicity_without_labels(spark):
    docs = fixture.frame(spark, fixture.corpus())
    labels = spark.createDataFrame([(0, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    terms, weights = toxicity.model(docs, labels)
    out = toxicity.scored(docs, terms, weights)
    assert out.columns.count("score") == 1 and out.count() == docs.count()
    assert out.where("score >= 0.7").count() == 0


# ---- WARC ---------------------------------------------------------------------------------------

PAGES = [(k, f"http://x/{k} y", t) for k, t in enumerate(["<p>a</p>", "", None, "é" * 5000, "<p>a</p>", "b\r\n\r\nWARC/1.1", "", "\x1f\x8b\x08 no member"])] + [(0, None, "<p>a</p>"), (None, "u", "<p>a</p>"), (None, None, "lone")]


@pytest.mark.parametrize("split", [97, 8 << 20])
def test_warc_round_trip(spark, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    path = storage.new_path(spark, "warc-test")
    manifest = warc.write(pages, path)
    assert manifest.selectExpr("sum(records)").first()[0] == len(PAGES)
    got = warc.read(spark, path, split).collect()
    first = {}
    for i, _, t in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(t or "", i)
    want = Counter()
    for i, _, t in PAGES:
        body = (t or "").encode()
        refers = first[t or ""] if first[t or ""] is not None and i != first[t or ""] else None
        want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.payload) == (dict((i, t) for i, _, t in PAGES)[r.page_id] or "").encode() for r in got if r.record_type == "response" and r.page_id is not None)


def test_warc_members_are_plain_gzip_and_false_magic_is_skipped():
    one = warc._member(1, "u", b"x" * 300, hashlib.sha1(b"x" * 300).hexdigest(), None, warc.DATE)
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\nWARC-Type: response")
    noise = b"\x1f\x8b\x08" + b"\0" * 40 + zlib.compress(b"q" * 100)
    other = gzip.compress(b"not an archive record")
    data = noise + one + other + one

    class Source(io.BytesIO):
        def read_at(self, n, at):
            return data[at : at + n]

    for step in (1, 7, 50, len(data)):
        found = [r for low in range(0, len(data), step) for r in warc.members(Source(), low, low + step)]
        assert len(found) == 2 and all(r.startswith(b"WARC/") for r in found)


def test_warc_of_an_empty_table(spark):
    path = storage.new_path(spark, "warc-test")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


# ---- mixing -------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        left = budget - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    rows = fixture.corpus(seed=2, n=150)
    got = mixing.mix(fixture.frame(spark, rows)).collect()
    sizes, most = Counter(), Counter()
    for _, value, _, source, *_ in rows:
        n = len(fixture.WORDS.findall(value or ""))
        sizes[source] += n
        most[source] = max(most[source], n)
    want = brute_targets(sizes)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-4)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * most[s] for s in sizes)
    again = mixing.mix(fixture.frame(spark, rows, 5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.mixed(fixture.frame(spark, rows))
    assert sum(len(fixture.WORDS.findall(r.text or "")) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(fixture.frame(spark, [], 1)).count() == 0


# ---- the pipeline -------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    r, words = random.Random(8), fixture.vocabulary()
    rows = fixture.corpus(seed=4)
    labels = []
    for k in range(120):
        bad = k % 3 == 0
        rows.append((9000 + k, fixture.prose(r, words, 40) + (" vilething " * 3 if bad else ""), "en", "a", 1, None, None))
        labels.append((9000 + k, 1, int(bad)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    fixture.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "mixing", "packing"]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = storage.materialize(stage(spark, before, str(tmp_path)), "stage")
        if name != "packing":
            assert after.columns == columns
        if name == "toxicity":
            left = {x.doc_id for x in after.collect()}
            assert not {9000 + k for k in range(0, 120, 3)} & left and {9000 + k for k in range(120) if k % 3} <= left
        if name == "line dedup":
            lines = Counter(frozenset(fixture.WORDS.findall(line)) for x in fixture.unique_ids([tuple(y) for y in after.collect()]) for line in (x[1] or "").split("\n"))
            assert all(n == 1 for words_, n in lines.items() if words_)
        if name == "near duplicates":
            assert after.count() <= before.count()
        if name == "packing":
            assert {x.doc_id for x in after.select("doc_id").collect()} == {x.doc_id for x in before.collect()}
        before = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == before.count()


def test_pipeline_keeps_columns_of_any_name_and_takes_empty_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    names = ["_gone", "_links", "_first", "_doc", "_runs", "_copy", "copy", "doc", "found", "key", "runs", "score", "Score_", "n_lines", "N_REMOVED", "n_links", "class_id", "label", "hashes", "_salt", "name", "range"]
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    base = spark.createDataFrame([(r[0], r[1], r[3], r[4]) for r in fixture.corpus(seed=6, n=20)], "doc_id long, text string, source string, n_chars long")
    docs = base.select("*", *(F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        after = storage.materialize(stage(spark, before, str(tmp_path)), "stage")
        if name == "packing":
            break
        assert after.columns == docs.columns and after.count() > 0
        for r in after.collect():
            assert all(r[n] == f"{n} {'none' if r.doc_id is None else r.doc_id}" for n in names), name
        before = after
    cut = suffix_dedup.dedup(docs)
    assert all(r[n] == f"{n} {'none' if r.doc_id is None else r.doc_id}" for r in cut.collect() for n in names if n != "N_REMOVED")  # that one is replaced
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = storage.materialize(stage(spark, empty, str(tmp_path)), "stage")
        assert empty.count() == 0
