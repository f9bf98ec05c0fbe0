"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import bpe, brown, chat, decontaminate, html_extract, langid, near_copies, quality, queries_text, simhash, substring, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n ", "en", None, 4), (4, "One two", "en", "a", 7), (4, "One two", "en", "a", 7),
    (5, PASSAGE + " tail of five", "en", "a", 1), (6, "head " + PASSAGE, "en", "b", 1), (7, "x" * 3000 + " " + "word " * 5000, "de", "a", 1),
    (None, "One two", "en", "a", 7), (8, "123 --- 456", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumns({"fp": F.lit(1), "ids": F.lit("x"), "_extra": F.lit(2), "n_words": F.lit(3)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries_text.VOCABULARY)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_bpe_as_the_library(spark, library):
    vocabulary = open(queries_text.VOCABULARY, encoding="utf-8").read()
    codec, decoder = bpe.Codec(vocabulary), bpe.Decoder(vocabulary)
    rng = np.random.default_rng(3)
    signs = list("abc dé'sΣσİǅß \x1c\x85\n12²Ⅷ中文🙂#*'llTA") + ["<|endoftext|>", " don't ", "́", "　"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(3000)] + ["ab" * 4000, "the " * 3000, ""]
    ids, counts = codec.encode_batch(texts)
    at = 0
    for text, n in zip(texts, counts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == want, text
        assert decoder.decode(want) == library.decode(want, skip_special_tokens=False)
        at += n


def test_bpe_table_of_long_words_is_bounded(monkeypatch, library):
    """Long words are encoded as ever, but do not stay once the table has too many characters."""
    monkeypatch.setattr(bpe, "CACHED_CHARS", 50_000)
    codec = bpe.Codec(open(queries_text.VOCABULARY, encoding="utf-8").read())
    for i in range(40):
        text = f"word{i} " + f"abc{i}def" * 1000
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert sum(map(len, codec._slots)) <= 50_000 + len(text)


def test_bpe_frame(docs, empty, library):
    rows = queries_text.bpe_digests(docs, queries_text.VOCABULARY).collect()
    want = sorted((str(r[0]), len(e := library.encode(r[1] or "", add_special_tokens=False).ids), digest(" ".join(map(str, e)))) for r in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in rows) == want
    assert queries_text.bpe_digests(empty, queries_text.VOCABULARY).count() == 0


def test_warc(spark, tmp_path):
    body = "<p>same" + "x" * 200
    rows = [(3, "http://c\r\nX: 1", body), (1, "http://a", body), (2, None, body), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", body), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    warc.write_archive(pages, str(tmp_path / "w"))
    read = {r.source_id: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert {k: r.record_type for k, r in read.items()} == {"1": "response", "2": "revisit", "3": "revisit", None: "revisit", "4": "response", "5": "response", "6": "response", "7": "response"}
    assert bytes(read["1"].payload).decode() == body and read["3"].refers_to == "1" and read["3"].payload is None
    assert bytes(read["7"].payload).decode() == rows[-1][2] and read["6"].payload_length == 0
    assert "\r" not in read["3"].target_uri
    some = warc.read_archive(spark, str(tmp_path / "w")).where("record_type = 'revisit' AND refers_to = '1'")
    assert some.count() == 3
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_warc_skips_unwanted_blocks(tmp_path):
    import io

    reader = warc.WarcReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [type(f) for f in reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)])] == [GreaterThan]
    record = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = list(warc.records(io.BytesIO(record % b"response" + record % b"revisit"), reader.wanted, True))
    assert [r["record_type"] for r in rows] == ["revisit"]


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, "ONE two"), (2, " ".join(f"w{i}" for i in range(20, 33))), (3, None), (4, "..."), (5, "absent words here"), (None, "123")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r["items"], r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got[(4, 2)] == got[(None, 2)] == (2, ["1"], True)
    assert got[(5, 63)] == got[(6, 61)] == (13, ["2"], True)
    assert got[(1, 0)] == got[(2, 0)] == (0, [], False) and got[(8, 2)] == (1, [], True)
    assert decontaminate.decontaminate(docs, items).count() == len(ROWS)
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.without_contaminated(docs, items).columns == docs.columns


def test_decontaminate_many_items_of_one_text(spark, docs, monkeypatch):
    """The items of a window are counted before they are broadcast; beyond the limit they are shuffled, with the same result."""
    items = spark.range(30_000).select(F.col("id").alias("item_id"), F.lit("ONE two").alias("text"))
    monkeypatch.setattr(decontaminate, "small_side", lambda df, rows: F.broadcast(df) if rows <= 1000 else df)
    got = [len(r["items"]) for r in decontaminate.decontaminate(docs, items).where("n_hit > 0").collect()]
    assert got == [30_000] * 3


def test_langid(spark, docs, empty):
    many = spark.createDataFrame([(i, "the cat and the dog of this", "en", "", 1) if i % 2 else (i, "der hund und die katze", "de", "", 1) for i in range(200)], DOCS)
    model = langid.train(many)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert langid.only_accepted(many, model).count() == 200 and langid.only_accepted(docs, langid.train(empty)).count() == 0
    assert got[1] == got[2] == got[3] == got[8] == ("und", 0.0)
    assert langid.predict(many, model).where("lang <> lang_pred").count() == 0
    assert all(0 <= s <= 1 for _, s in got.values()) and langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(empty)).collect()} == {"und"}


def test_langid_held_out_accuracy(spark):
    rows = queries_text.op4_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.98 * len(rows)


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_languages_left_out_are_rejected(spark, left_out):
    """Trained on two thirds of the rows in three languages: texts of the fourth are rejected, held-out texts of the three are kept."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text RLIKE '[A-Za-z]'")
    held_out = queries_text.fold(F.col("doc_id"), 3) == 1
    model = langid.train(rows.where(~held_out & (F.col("lang") != left_out)))
    asked = rows.where(held_out | (F.col("lang") == left_out))
    shares = {r[0]: r[1] for r in langid.predict(asked, model).groupBy(F.col("lang") == left_out).agg(F.avg(F.col("accepted").cast("int"))).collect()}
    assert shares[True] <= 0.1 and shares[False] >= 0.98, shares


def test_more_languages_than_are_frequent(spark):
    """No label is left out for being rare: 300 of them, 4 rows each."""
    rows = [(4 * i + k, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in "abcdefgh"), f"l{i:03}", "", 1) for i in range(300) for k in range(4)]
    assert len(langid.train(spark.createDataFrame(rows, DOCS), epochs=1).languages) == 300


def test_chat(spark):
    rows = [(1, 0, "user", "a\\[INST]"), (1, 1, "assistant", None), (2, 0, "assistant", "</s>"), (3, 1, "x>> y", "t"), (3, 1, None, "t"), (3, 1, None, "t"), (None, 0, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(turns)
    assert {(r.conv_id, r.seq): r.valid for r in out.collect()} == {(1, 0): True, (1, 1): True, (2, 0): False, (3, 0): False, (3, 1): False, (3, 2): False, (None, 0): True}
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert back[1].turns_sha256 == digest("user\na\\[INST]\nassistant\n\n") and back[2].loss_sha256 == digest("</s>")
    assert back[3].turns_sha256 == digest("\nt\n\nt\nx>> y\nt\n") and back[3].loss_chars == 0
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def brute_simhash(texts):
    import xxhash

    prints = {}
    for key, text in texts:
        own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([" ".join(own)] if own else [])
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints[key] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    root = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[b] > root[a]:
                    root[b] = root[a]
                    changed = True
    return {k: (f"{prints[k]:016x}", root[k]) for k in prints}


def test_simhash_brute_force(spark, docs, empty):
    from gleaner.llm import queries_sets

    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries_sets.op6_simhash(spark, folder).collect()}
    assert got == brute_simhash(texts)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, None)} == {4}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect())[:2] == [1, 4] and kept.where("doc_id = 4").count() == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_near_copies_brute_force(spark, docs, empty):
    texts = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    rng = np.random.default_rng(5)
    base = [words(texts[i]) for i in sorted(texts) if len(words(texts[i])) > 200][:40]
    for n, own in enumerate(base):
        for edits in (1, 3, 6):
            copy = list(own)
            for at in rng.integers(0, len(own), edits):
                copy[at] = f"edit{rng.integers(1 << 40)}"
            texts[1_000_000 + 10 * n + edits] = " ".join(copy)
    sets = {i: set(near_copies.shingles(t)) for i, t in texts.items()}
    holders = {}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    similar = [(a, b) for a, b in sorted(pairs) if near_copies.similarity(texts[a], texts[b]) >= 0.8]
    for a, b in similar:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    kept = {r.doc_id for r in near_copies.one_of_each(rows).select("doc_id").collect()}
    assert len(similar) > 100 and kept == {i for i in texts if find(i) == i}
    left = near_copies.one_of_each(docs)  # 6 holds the passage of 5 between other words; both rows of 4 stay together
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in ROWS if r[0] != 6)
    same = spark.createDataFrame([(2, "a b"), (1, "A b"), (None, "a b"), (3, None), (4, ""), (5, None)], "doc_id long, text string").withColumn("_gone", F.lit(1))
    assert sorted(str(r.doc_id) for r in near_copies.one_of_each(same).collect()) == ["1", "3", "4", "5", "None"]
    assert near_copies.one_of_each(empty).count() == 0


def edited(own, edits, name):
    """The words with one in ``len(own) // edits`` replaced, at other places for each name."""
    copy, gap = list(own), len(own) // edits
    for i in range(edits):
        copy[i * gap + name % gap] = f"edit{name}x{i}"
    return " ".join(copy)


@pytest.mark.parametrize("place", ["first", "middle", "last"])
def test_near_copies_of_one_original(spark, place):
    """Copies that resemble the original, but not each other, go wherever its id lies; so do chains of copies of copies."""
    own = [f"v{i}" for i in range(300)]
    copies = [edited(own, 6, n) for n in range(40)]
    at = {"first": 0, "middle": 20, "last": 40}[place]
    texts = copies[:at] + [" ".join(own)] + copies[at:]
    assert near_copies.similarity(copies[0], " ".join(own)) >= 0.8 > near_copies.similarity(copies[0], copies[20])
    chain = [[f"u{i}" for i in range(300)]]
    for n in range(8):
        chain.append(edited(chain[-1], 6, 7 * n).split())
    order = [3, 7, 1, 5, 0, 8, 4, 2, 6]
    rows = list(enumerate(texts)) + [(100 + i, " ".join(chain[n])) for i, n in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [0, 100]
    assert sorted(r.doc_id for r in near_copies.one_of_group(docs).collect()) == [0, 100]


def test_simhash_links_lose_none(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40)
    prints = sorted({int(b) ^ int(x) for b in base for x in (0, 1 << 3, (1 << 40) | 1, (1 << 31) | (1 << 62), 7, 3 << 20)})
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert got == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}


def test_quality(spark, docs, empty):
    rows = {(r.doc_id, r.n_words): r for r in quality.ledger(docs).collect()}
    assert rows[(7, 5001)].n_repeat_words == 5000 and rows[(1, 0)].failed_bits == 1 and rows[(3, 0)].n_words == 0
    ledger = quality.ledger(docs)
    got = {r.rule: (r.n_failed, r.n_alone) for r in quality.ablations(ledger, quality.STRICT).collect()}
    assert got["few_words"] == (7, 7) and got["repeated_words"][0] == 1
    assert quality.ledger(empty).count() == 0


def brute_repeats(own):
    seen = {}
    for i in range(len(own) - 2):
        seen.setdefault(tuple(own[i : i + 3]), []).append(i)
    return len({p for places in seen.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)})


def test_quality_of_a_million_words(spark):
    """Colliding hash bits between two equal runs do not hide them."""
    rng = np.random.default_rng(4)
    own = [f"w{i}" for i in rng.integers(0, 140, 1_200_000)]
    row = quality.measured(spark.createDataFrame([(" ".join(own),)], "text string")).first()
    assert row.n_words == len(own) and row.n_repeat_words == brute_repeats(own)


def test_brown(spark, docs, empty):
    model = brown.fit(docs)
    rows = brown.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert model.n_tokens == sum(len(words(r[1])) + 1 for r in ROWS)
    blank = brown.score(docs, brown.fit(empty)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in blank)


def test_brown_probabilities_sum_to_one(spark, docs):
    """Over all known words, the end and one unseen word per class, whatever class came before."""
    model = brown.fit(docs)
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    units = model.lexicon.place(list(counts))[1]
    emitted = [(model.classes[u], n) for u, n in zip(units, counts.values())] + [(0, model.end_count)]
    for before in (0, int(model.classes[units[0]])):
        seen = sum(10 ** (model.follow[before, c]) * (n + brown.ADD) for c, n in emitted)
        unseen = sum(10 ** (model.follow[before, c]) * brown.ADD for c in range(brown.CLASSES))
        assert abs(seen + unseen - 1) < 1e-9


def test_html():
    page = """<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, many.</div>
      <article><h1>A &amp; B</h1><p>First   para,<br>with text &lt;x&gt;.<p>Second <b>bold</b> one, <a href="/l">link</a>.</article>
      <div id=comments><p>Great, really, great.</p></div><aside>More, to, read</aside><form><p>Mail, please</p></form><footer>(c)</footer>"""
    assert html_extract.extract(page) == "A & B\n\nFirst para, with text <x>.\n\nSecond bold one, link."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<script>var a</script>") == ""
    assert html_extract.extract("no markup") == "no markup"
    assert "deep" in html_extract.extract("<div>" * 3000 + "deep, text" + "</div>" * 10)
    assert html_extract.extract("<p>cut off <a href='x") != ""
    assert len(html_extract.extract("<p>" + "long word, " * 50_000 + "</p>")) > 500_000


def test_html_wrappers_and_sources():
    """A word in the class of a wrapper does not take the page; sources stay in an article, comments and related articles go."""
    prose = "<p>Some long first paragraph, with commas, and more words.</p><p>A second one, which goes on, and ends.</p>"
    want = "Some long first paragraph, with commas, and more words.\n\nA second one, which goes on, and ends."
    for wrapper in ("class='layout has-sidebar'", "id='page' class='no-sidebar'", "class='post social-enabled'"):
        for inner in ("article", "main", "div"):
            page = f"<body><div {wrapper}><{inner}>{prose}</{inner}><div class=sidebar><p>Other, short.</p></div></div></body>"
            assert html_extract.extract(page) == want, page
    comments = "<div id=comments>" + "<article class=comment><p>" + "Long, long, comment. " * 40 + "</p></article>" * 1 + "</div>"
    related = "<div class=related><article><p>Another, story.</p></article></div>"
    assert html_extract.extract(f"<body><article>{prose}{related}</article>{comments}</body>") == want
    sources = "<ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul>"
    menu = "<ul class=menu><li><a href=/3>Start</a></li></ul>"
    assert html_extract.extract(f"<article>{prose}{sources}{menu}</article>") == want + "\n\nFirst source\n\nSecond source"
    assert html_extract.extract("<div class=notice><p>All there is.</p></div>") == "All there is."


def brute_removed(texts, window=35):
    own = [words(t) for t in texts]
    seen = {}
    for t, w in enumerate(own):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((t, i))
    gone = [set() for _ in own]
    for places in seen.values():
        if len(places) > 1:
            for t, i in places:
                gone[t].update(range(i, i + window))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(own, gone)]


def test_substring(spark, docs, empty):
    got = sorted(((r.n_words, r.n_removed, r.kept) for r in substring.cut(docs).collect()))
    assert got == sorted(brute_removed([r[1] for r in ROWS]))
    assert substring.cut(empty).count() == 0


@pytest.mark.parametrize("shard", [1, 2000])
def test_substring_brute_force(spark, monkeypatch, shard):
    """Few words, so that windows overlap in many ways; with the lower limit, seeds are split by window."""
    monkeypatch.setattr(substring, "SHARD", shard)
    rng = np.random.default_rng(9)
    pool = [" ".join(rng.choice(["a", "b", "c"], 30)) for _ in range(12)]
    texts = [" ".join(rng.choice(pool, rng.integers(1, 6))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.cut(rows, window=9, gram=4).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 9)


def test_pipeline_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        assert out.join(docs.select("doc_id"), "doc_id").count() == out.count() > 0.8 * docs.count()
    final = corpus_pipeline.run(spark, folder)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and final.count() > 0


def test_pipeline_edges(spark, docs):
    clash = ("n_words", "n_removed", "kept", "_lang", "_accepted", "_key", "_digest")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(c).alias(c) for c in clash])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, "/root/testdata/sf0.001")
        assert out.columns == rows.columns
        assert all(r[c] == c for r in out.collect() for c in clash)
        assert stage(spark, rows.limit(0), "/root/testdata/sf0.001").count() == 0


def test_pipeline_keeps_one_of_each_group_without_ids(spark):
    """Null and repeated ids on different texts: every group keeps one row, a unique text is never lost to a copy."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(80)) for c in "abc")
    rows = [(None, one), (None, two), (None, two), (3, three), (7, "z unlike all " + one[::-1]), (7, three), (None, three), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([("None", one), ("None", two), ("3", three), ("7", rows[4][1]), ("8", None)], key=str)
    assert sorted([(str(r.doc_id), r.text) for r in simhash.one_of_each(docs).collect()], key=str) == want
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted([(str(r.doc_id), r.text) for r in stage(spark, docs, "").collect()], key=str) == want


INNER = ("_text", "_words", "_lines", "_runs", "_clash", "_whole", "_at", "_key", "_digest", "_left", "_spans", "_scored", "_p", "_row", "more", "more_logs",
         "_both", "_apart0", "key", "own", "root", "row", "fp", "id", "digest", "size", "spans", "items", "hash", "word", "n", "times", "segment", "starts", "_Key")


@pytest.mark.parametrize("inner", [INNER[i::2] for i in range(2)])
def test_columns_of_the_caller_survive(spark, docs, inner):
    """Columns named like those that exist only inside an operator, and one of type map, keep their values."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(c + " "), F.coalesce("doc_id", F.lit(0))).alias(c) for c in inner])
    rows = rows.withColumn("a map", F.create_map(F.lit("id"), F.col("doc_id")))
    many = spark.createDataFrame([(i, "the cat and the dog of this", "en", "", 1) if i % 2 else (i, "der hund und die katze", "de", "", 1) for i in range(50)], DOCS)
    items = spark.createDataFrame([(1, "ONE two")], "item_id long, text string")
    outs = {
        "quality": (quality.ledger(rows), len(ROWS)), "langid": (langid.predict(rows, langid.train(many)), len(ROWS)), "brown": (brown.score(rows, brown.fit(many)), len(ROWS)),
        "bpe": (bpe.round_trip(rows, queries_text.VOCABULARY), len(ROWS)), "substring": (substring.cut(rows), len(ROWS)),
        "decontaminate": (decontaminate.without_contaminated(rows, items), len(ROWS) - 3), "near_copies": (near_copies.one_of_group(rows), None),
    }
    for name, (out, n) in outs.items():
        got = out.collect()
        assert n in (None, len(got)), name
        for r in got:
            assert [r[c] for c in inner] == [f"{c} {r.doc_id or 0}" for c in inner] and r["a map"] == {"id": r.doc_id}, name


@pytest.mark.parametrize("key, text", [("_key", "_text"), ("_digest", "_scored"), ("_row", "_left")])
def test_keys_and_texts_of_any_name(docs, key, text):
    rows = docs.select(F.col("doc_id").alias(key), F.col("text").alias(text))
    assert quality.ledger(rows, text).columns[:2] == substring.cut(rows, key, text).columns[:2] == [key, text]
    assert {r[key]: r.n_removed for r in substring.cut(rows, key, text).collect()}[5] == 60
    assert langid.predict(rows, langid.train(docs), text).columns == [key, text, "lang_pred", "score", "accepted"]
    assert brown.score(rows, brown.fit(rows, text), text).columns[0] == key and bpe.round_trip(rows, queries_text.VOCABULARY, text).columns[:2] == [key, text]
