"""Each corpus operator and the pipeline on clashing names, long texts, string ids, repeats, ties and empty tables."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isoloom.llm import decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, quote_links, sentence_pieces, shared, substring_dedup, token_counts

SCHEMA = "doc_id long, text string"
FRENCH, ENGLISH = "le chat est sur la table et il dort dans la maison ", "the cat is on the table and it sleeps in the house "


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary(sentence_pieces.MODEL)


def operators(spark, vocabulary):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    model = language_id.Model({"en": [ENGLISH], "fr": [FRENCH]})
    return {
        "op1": (lambda d: sentence_pieces.encode(d, decoded="decoded"), ["tokens", "decoded"]),
        "op1 back": (lambda d: sentence_pieces.decode(sentence_pieces.encode(d)), ["tokens", "decoded"]),
        "op2": (lambda d: language_id.predict(d, model), ["lang_pred", "score"]),
        "op3": (lambda d: decontaminate.search(d, bench), ["n_words", "hits", "items"]),
        "op4": (line_dedup.dedup_lines, ["kept_text", "n_lines", "n_dropped"]),
        "op6": (exact_dedup.dedup, []),
        "op8": (near_dedup.dedup, []),
        "op9": (lambda d: token_counts.count_tokens(d, vocabulary), ["n_words", "n_tokens"]),
        "op10": (substring_dedup.mark_repeats, ["n_words", "n_removed", "kept_text"]),
    }


CLASHES = ["tokens", "DECODED", "lang_pred", "score", "__letter", "x_letter", "n_words", "hits", "items", "kept_text", "n_lines", "n_dropped", "__id", "__t", "__digest", "__n", "__d", "__i", "__h", "__cell", "x_d", "x_h", "x_part", "c0", "c1", "id", "t", "key", "run", "keep", "words", "spots", "n_removed", "N_TOKENS", "component_id", "bucket"]


def test_clashing_names(spark, vocabulary):
    """Added names give way to results; all others pass with their values."""
    docs = [(1, f"alpha beta gamma\n{ENGLISH}"), (2, f"{FRENCH}\n\n"), (3, None)]
    plain = spark.createDataFrame(docs, SCHEMA)
    wide = plain.select(*[F.lit(f"v{k}").alias(c) for k, c in enumerate(CLASHES[:20])], "*", *[F.lit(f"v{k + 20}").alias(c) for k, c in enumerate(CLASHES[20:])])
    for name, (run, added) in operators(spark, vocabulary).items():
        want = {r.doc_id: r.asDict() for r in run(plain).collect()}
        out = run(wide)
        assert [c for c in out.columns if c.lower() in added] == added, name
        assert {c for c in out.columns} == {c for c in CLASHES if c.lower() not in added} | {"doc_id", "text", *added}, name
        for r in out.collect():
            own = r.asDict()
            assert {k: own[k] for k in want[r.doc_id]} == want[r.doc_id], name
            assert all(own[c] == f"v{k}" for k, c in enumerate(CLASHES) if c.lower() not in added), name
    for run in (exact_dedup.mark, lambda d: near_dedup.summary(d), lambda d: license_scan.summary(license_scan.scan(d)), lambda d: language_id.identify(d.withColumn("lang", F.lit("en")))):
        assert sorted(map(tuple, run(wide).collect()), key=repr) == sorted(map(tuple, run(plain).collect()), key=repr)
    chats = spark.createDataFrame([(1, 0, "a line"), (1, 1, "> a line\nyes")], "conv_id long, turn long, text string")
    more = chats.select(*[F.lit("v").alias(c) for c in ("own", "plain", "depth", "passages", "__l", "x_c", "seq", "c0")], "*")
    want = [(r.turn, r.own, r.parent_turn, r.depth, r.seq) for r in quote_links.conversations(chats).collect()]
    got = quote_links.conversations(more)
    assert [(r.turn, r.own, r.parent_turn, r.depth, r.seq) for r in got.collect()] == want == [(0, "a line", None, 0, 0), (1, "yes", 0, 1, 1)]
    assert {"plain", "passages", "__l", "x_c", "c0"} <= set(got.columns)


def test_needed_name_in_another_case(spark):
    d = spark.createDataFrame([(1, "x", "one two"), (2, "x", "one two")], "doc_id long, TEXT string, text string")
    assert {r.doc_id: r.kept for r in exact_dedup.mark(d).collect()} == {1: False, 2: True}
    assert exact_dedup.dedup(d).collect()[0].asDict() == {"doc_id": 2, "TEXT": "x", "text": "one two"}


def thue_morse(n, a, b):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


def test_words_on_which_polynomials_modulo_2_64_collide(spark):
    one, two = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    same = [f"w{k}" for k in range(34)]
    d = spark.createDataFrame([(1, " ".join([*same, one])), (2, " ".join([*same, two]))], SCHEMA)
    assert [r.n_removed for r in substring_dedup.mark_repeats(d).collect()] == [0, 0]
    d = spark.createDataFrame([(1, one), (2, two), (3, one)], SCHEMA)
    assert {r.doc_id: r.component_id for r in near_dedup.summary(d).collect()} == {1: 1, 2: 2, 3: 1}


def test_long_lines_of_marks(spark):
    """A million marks, lines and blanks: no recursion, and time in proportion to the text."""
    began = time.time()
    texts = [">" * 1_000_000 + " deep", "> " * 500_000, "\n".join(["> a"] * 100_000), "own\n" * 100_000]
    out = quote_links.link(spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "conv_id long, turn long, text string")).collect()
    assert [r.n_quoted for r in sorted(out, key=lambda r: r.turn)] == [1, 1, 100_000, 0]
    blank = [(1, "a" + " " * 500_000 + "b"), (2, " " * 500_000), (3, "x" * 30 + " " * 300_000 + "\n" + " " * 300_000 + "y" * 30)]
    out = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(spark.createDataFrame(blank, SCHEMA)).collect()}
    assert out == dict(blank)
    assert time.time() - began < 90


def test_long_texts(spark, vocabulary):
    """5 MB in one text, of words that the operators look for."""
    rng = random.Random(4)
    words = ["permission", "license", "mit", "the", "apache", "table", "of", "cat"]
    long = " ".join(rng.choice(words) for _ in range(900_000))
    d = spark.createDataFrame([(1, long), (2, long), (3, "the cat"), (4, "\n".join(f"line {k % 1000} of the long text" for k in range(150_000)))], SCHEMA)
    began = time.time()
    w = long.split()
    scan = {r.doc_id: r for r in license_scan.summary(license_scan.scan(d)).collect()}
    assert scan[1].n_words == len(w) and scan[1].n_base == sum(w[k : k + 2] in (["mit", "license"], ["apache", "license"]) for k in range(len(w)))
    assert {r.doc_id: r.kept for r in exact_dedup.mark(d).collect()} == {1: False, 2: True, 3: True, 4: True}
    assert {r.doc_id: r.component_id for r in near_dedup.summary(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(d).collect()} == dict.fromkeys([1, 2, 3, 4], 0)
    assert {r.doc_id: r.n_removed for r in substring_dedup.mark_repeats(d).collect()} == {1: len(w), 2: len(w), 3: 0, 4: 150_000 * 6}
    assert all(r.round_trip for r in sentence_pieces.summary(d).collect())
    assert {r.doc_id: r.n_words for r in token_counts.token_totals(d, vocabulary).collect()}[1] == len(w)
    found = decontaminate.summary(decontaminate.search(d, spark.createDataFrame([(1, " ".join(w[500:520]))], "item_id long, text string"))).collect()
    assert {r.doc_id: r.n_items for r in found} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert {r.doc_id: r.lang_pred for r in language_id.predict(d, language_id.Model({"en": [ENGLISH], "fr": [FRENCH]})).collect()}[1] == "en"
    assert time.time() - began < 300


def test_string_ids_repeats_and_ties(spark):
    rows = [("b", "same text here for all of them"), ("a", "same text here for all of them"), ("c", "other words than these"), ("c", "other words than these"), (None, "same text here for all of them"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    marked = sorted(((r.doc_id or "", r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark(d).collect()), key=repr)
    assert marked == [("", "b", 3, False), ("", None, 1, True), ("a", "b", 3, False), ("b", "b", 3, True), ("c", "c", 2, True), ("c", "c", 2, True)]
    assert sorted(r.doc_id or "" for r in exact_dedup.dedup(d).collect()) == ["", "b", "c"]
    assert {r.keep_id for r in exact_dedup.mark(d, largest=False).collect()} == {"a", "c", None}
    assert {(r.doc_id, r.component_id) for r in near_dedup.summary(d).collect()} == {("b", "a"), ("a", "a"), ("c", "c"), (None, None)}
    lines = {(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(d).collect()}
    assert lines == {("b", 0), ("a", 1), ("c", 0), (None, 1), (None, 0)}
    assert len(license_scan.scan(d).collect()) == len(rows)


def test_runs_and_rounds(spark):
    """Any number of runs and any fan-in give the same texts; keys whose digests agree stay apart by length and check."""
    rng = random.Random(11)
    rows = [(k, f"text {rng.randrange(60)}") for k in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    want = {hashlib.sha256(t.encode()).digest(): (max(v), len(v)) for t, v in want.items()}
    entries = exact_dedup.digests(d)
    for runs, fanin in ((1, 2), (2, 2), (16, 4), (7, 3)):
        assert {bytes(r.digest): (r.keep_id, r.group_size) for r in exact_dedup.final_run(entries, runs=runs, fanin=fanin).collect()} == want
    forged = entries.withColumn("digest", F.lit(b"0" * 32))
    assert exact_dedup.final_run(forged).count() == len(want)


def test_line_runs(spark):
    """Batches, levels and compaction against a direct count."""
    rng = random.Random(12)
    lines = [(rng.randrange(300), 7, pos, rng.randrange(50), 1) for pos in range(2000)]
    d = spark.createDataFrame(lines, "id long, t long, pos int, h1 long, h2 long")
    want = {}
    for i, _, _, h, _ in lines:
        want.setdefault(h, []).append(i)
    want = {h: (max(v), len(set(v)), len(v)) for h, v in want.items()}
    for batches, fanin in ((1, 2), (4, 2), (7, 3)):
        assert {r.h1: (r.keep, r.docs, r.n) for r in line_dedup.run_index(d, batches, fanin).collect()} == want
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("isoloom_run")] == []


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW_ROWS", 10)
    monkeypatch.setattr(shared, "HOT_SHARE", 20)
    rng = random.Random(13)
    left = [(0 if rng.random() < 0.5 else rng.randrange(1, 50), k) for k in range(500)]
    right = [(k, v) for k in range(40) for v in range(2)]
    one, two = shared.materialize(spark.createDataFrame(left, "k long, i long"), "left"), spark.createDataFrame(right, "k long, v long")
    assert sorted(map(tuple, shared.spread_join(one, two, ["k"]).select("k", "i", "v").collect())) == sorted((k, i, v) for k, i in left for j, v in right if j == k)
    out = shared.spread_join(one, two.filter("v = 0"), ["k"], "left").select("k", "i", "v").collect()
    assert sorted(map(tuple, out), key=repr) == sorted(((k, i, 0 if k < 40 else None) for k, i in left), key=repr)
    # the operators with every key hot
    docs = [(k, "a line that many documents share\nand another one of them all" if k % 3 else f"its own {k} words are these and no others") for k in range(60)]
    d = spark.createDataFrame(docs, SCHEMA)
    assert {r.doc_id for r in line_dedup.dedup_lines(d).filter("n_dropped > 0").collect()} == {k for k in range(60) if k % 3 and k != 59}
    assert {r.keep_id for r in exact_dedup.mark(d).filter("group_size > 1").collect()} == {59}
    assert {r.component_id for r in near_dedup.summary(d).collect()} == {1} | {k for k in range(60) if not k % 3}


def test_intermediate_tables_are_deleted(spark):
    before = shared.made()
    table = shared.materialize(spark.range(3), "gone")
    import os

    path = table.isoloom_path
    assert os.path.isdir(path)
    shared.discard_all(keep=before)
    assert not os.path.exists(path) and shared.made() == before


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def greedy_phrases(text, sample):
    at = n = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += max(size, 1)
        n += 1
    return n


def test_cross_parse(spark):
    """Phrases, winner and score of whole texts against a direct parse, whatever the segments."""
    rng = random.Random(14)
    for trial in range(25):
        samples = {"a": ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 60)))], "b": ["abab ca cab", "bb"], "c": ["Ca C"]}
        m = language_id.Model(samples)
        whole = {k: "".join(" " if c.isspace() else c.lower() for t in v for c in t + "\n") for k, v in samples.items()}
        texts = ["".join(rng.choice("abcqB ") for _ in range(rng.randrange(0, 200))) for _ in range(6)] + ["a" * 300, "ab" * 150, "q"]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = m.phrases(np.array([ord(c) for t in texts for c in t]), off, segment=rng.choice([3, 7, 50, 512]), block=rng.choice([1, 2, 5, 2048]))
        want = [[greedy_phrases(t.lower(), whole[k]) for t in texts] for k in m.languages]
        assert got.tolist() == want
        cost = np.array(want) * np.array(m.bits)[:, None] / np.maximum([len(t) for t in texts], 1)
        d = spark.createDataFrame(list(enumerate(texts)), SCHEMA) if trial == 0 else None
        if d is not None:
            for r in language_id.predict(d, m).collect():
                if re.search("[a-zA-Z]", r.text):
                    two = sorted(cost[:, r.doc_id])[:2]
                    assert r.lang_pred == m.languages[int(cost[:, r.doc_id].argmin())] and abs(r.score - max(0, 1 - two[0] / two[1])) < 1e-9


def test_near_recall_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.82 are linked, and those just below are not."""
    rng = np.random.default_rng(15)
    docs, linked = [], {}
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 204)]
        other = list(words)
        changed = 22 if k % 2 else 24
        # the last words differ: sets of 200 shingles of 5 words each, of which 200 - changed are common
        other[-changed:] = [f"v{x}" for x in rng.integers(0, 10**9, changed)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        common = 200 - changed
        linked[2 * k + 1] = 100 * common >= 80 * (400 - common)
    got = {r.doc_id: r.component_id for r in near_dedup.summary(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert any(linked.values()) and not all(linked.values())
    assert all((got[i] == i - 1) == yes for i, yes in linked.items())


def brute_links(rows):
    """By (conv, turn) own text, parent, root, depth, numbers of quoted lines and of links."""
    read = {}
    for conv, turn, text in rows:
        own, plain, passages, before, quoted = [], [], [], 0, 0
        for no, line in enumerate((text or "").split("\n")):
            head = re.match(r"[ \t>]*", line).group()
            level = head.count(">")
            rest = line[head.rfind(">") + 1 :] if level else line
            shown = " ".join(rest.translate(shared_lower).split())
            if level:
                quoted += 1
                if level != before:
                    passages.append((level, no, []))
                if shown:
                    passages[-1][2].append(shown)
            else:
                own.append(line)
                plain += [shown] if shown else []
            before = level
        read[conv, turn] = ("\n".join(own), plain, [p for p in passages if p[2]], quoted)
    out = {}
    for (conv, turn), (own, _, passages, quoted) in sorted(read.items()):
        links = []
        for level, no, lines in passages:
            held = [t for c, t in read if c == conv and t < turn and any(read[c, t][1][i : i + len(lines)] == lines for i in range(len(read[c, t][1])))]
            if held:
                links.append((level, no, max(held)))
        parent = min(links)[2] if links else None
        root, depth = (out[conv, parent][2], out[conv, parent][3] + 1) if links else (turn, 0)
        out[conv, turn] = (own, parent, root, depth, quoted, len(links))
    return out


shared_lower = str.maketrans(shared.UPPER, shared.LOWER)


def test_quotes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quote_links, "SPAN", 8)
    rng = random.Random(16)
    rows = []
    for conv in range(330):
        texts = []
        for turn in range(rng.choice([1, 5, 30, 90]) if conv else 800):
            lines = [rng.choice(["ok", "Thanks  a lot", "the\tplan", "", f"own {rng.randrange(9)}", "why?"]) for _ in range(rng.randrange(1, 9))]
            for _ in range(rng.randrange(3)):
                if texts:
                    source = [x for x in rng.choice(texts[-12:]).split("\n")]
                    a = rng.randrange(len(source))
                    mark = rng.choice(["> ", ">", "  > ", ">\t"])
                    at = rng.randrange(len(lines) + 1)
                    lines[at:at] = [mark + (x.upper() if rng.random() < 0.5 else x) for x in source[a : a + rng.randrange(1, 8)]]
            texts.append("\n".join(lines))
            rows.append((conv, turn, texts[-1]))
    assert len(rows) > 8000
    want = brute_links(rows)
    got = quote_links.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert {(r.conv_id, r.turn): (r.own, r.parent_turn, r.root_turn, r.depth, r.n_quoted, r.n_links) for r in got} == want
    assert sum(x[5] for x in want.values()) > 3000
    order = [(r.conv_id, r.root_turn, r.turn) for r in got]
    assert order == sorted(order) and all(r.seq == (0 if k == 0 or got[k - 1].conv_id != r.conv_id else got[k - 1].seq + 1) for k, r in enumerate(got))


def test_quotes_by_hand(spark):
    m = [
        (1, 0, "user", "Hello there, general question.\nSecond   line\n\nlast"),
        (1, 1, "assistant", "> hello there, GENERAL question.\n> Second line\nAn answer"),
        (1, 2, "user", "A new thread"),
        (1, 3, "assistant", ">> Hello there, general question.\n> An answer\nDeeper"),
        (1, 4, "user", "> not known\nfresh"),
        (1, 5, "user", "> A new thread\nreply"),
        (2, 0, "user", "> Hello there, general question.\nother conversation"),
        (2, 1, None, None),
        (None, 1, "user", "x"),
        (3, None, "user", "> x\ny"),
        (1, 5, "user", "> A new thread\nreply"),
    ]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    got = quote_links.conversations(df).collect()
    own = {(r.conv_id, r.turn): (r.own, r.parent_turn, r.root_turn, r.depth, r.n_quoted) for r in got}
    assert own[1, 1] == ("An answer", 0, 0, 1, 2) and own[1, 3] == ("Deeper", 1, 0, 2, 2)
    assert own[1, 4] == ("fresh", None, 4, 0, 1) and own[1, 5] == ("reply", 2, 2, 1, 1) and own[2, 0][1] is None and own[2, 1][0] == ""
    assert own[3, None][:3] == ("y", None, None) and len(got) == len(m)
    assert [(r.turn, r.seq) for r in got if r.conv_id == 1] == [(0, 0), (1, 1), (3, 2), (2, 3), (5, 4), (5, 5), (4, 6)]
    # two messages of one turn, each with half of what is quoted, do not hold it
    split = [(1, 0, "a\nb"), (1, 0, "c\nd"), (1, 1, "> a\n> b\n> c"), (1, 2, "> b\n> b\n> c\n> d")]
    got = {r.turn: r.parent_turn for r in quote_links.link(spark.createDataFrame(split, "conv_id long, turn long, text string")).collect()}
    assert got == {0: None, 1: None, 2: None}
    assert quote_links.conversations(df.limit(0)).collect() == []


WIDE = "doc_id long, text string, lang string, source string, n_chars long"


def pipeline_rows(spark, tmp_path, rows, schema=WIDE, more=()):
    """run() over documents of these rows."""
    folder = str(tmp_path / f"in{time.time_ns()}")
    spark.createDataFrame(rows, schema).select("*", *more).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "eight words of one item that must leak out")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, folder)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty, long, repeated and tied rows, clashing names, and an empty table."""
    long = FRENCH * 20_000
    rows = [
        (1, ENGLISH, "en", "s", 1), (2, ENGLISH, None, None, None), (2, ENGLISH, None, None, None), (3, None, "en", "s", 0), (4, "", "fr", "s", 0), (5, "12 34 !!", "en", "s", 8),
        (6, long, "fr", "s", 5), (7, FRENCH, "fr", "s", 3), (None, "a text whose id is null but that has letters", "en", "s", 2), (8, "x " + "Eight words of one item that must leak, out! y", "en", "s", 9),
        *[(k, f"{ENGLISH * 3} number {k}", "en", "s", 4) for k in range(20, 60)],
    ]
    out = pipeline_rows(spark, tmp_path, rows, more=[F.lit("v").alias(c) for c in ("tokens", "id", "x_d", "__h", "lang_pred", "n_words")]).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and {2, 6, 7, None} <= set(ids) and not {1, 3, 4, 5, 8} & set(ids)
    assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in out)
    assert pipeline_rows(spark, tmp_path, [], WIDE).collect() == []
