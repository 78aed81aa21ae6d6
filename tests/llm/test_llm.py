"""Corpus operators against brute force, SQL and hand-made cases: nulls, empty and long texts, ties, repeated rows."""

import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from isoloom.llm import decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, sentence_pieces, substring_dedup, token_counts
from isoloom.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "É   ß x 中文 🙂"), (5, LONG), (6, LONG), (6, LONG), (7, "!!! ... ***"), (None, "no id here"), (8, "a\r\nb\x00c\x0bd\x0ce"), (9, "x" * 30_000)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = c.sql(Q.ORACLES[name]).df()[columns].astype(str).values.tolist()
    assert sorted(df.toPandas()[columns].astype(str).values.tolist()) == sorted(want)


def test_pieces(spark, odd, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    more = spark.createDataFrame([(20, "  two  spaces "), (21, "line\n\n\tfeeds \n x"), (22, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"), (23, "the▁mark"), (24, "\n"), (25, "ﬁ Ａ é é")], SCHEMA)
    docs = odd.filter("doc_id is null or doc_id <> 9").unionByName(more)
    out = sentence_pieces.encode(docs, decoded="back").collect()
    for r in out:
        assert r.tokens == (None if r.text is None else m.encode(r.text))
        assert r.back == (None if r.text is None else r.text.replace("▁", " "))
    again = sentence_pieces.decode(sentence_pieces.encode(docs)).collect()
    assert {r.decoded for r in again} == {r.back for r in out}
    assert rows(sentence_pieces.summary(empty)) == []


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language_id.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) > 0.9
    model = language_id.fit(docs)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert all(out[k] == ("und", 0.0) for k in (1, 2, 3, 7)) and out[5][0] in model.languages
    assert rows(language_id.predict(empty, model)) == []
    none = language_id.predict(odd, language_id.Model({})).collect()
    assert all(r.lang_pred == "und" for r in none)


def test_decontaminate(spark, odd, empty):
    rng = random.Random(1)
    words = [f"v{k}" for k in range(6)]
    bench = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 11])))) for k in range(12)] + [(None, "v1 v2"), (99, None), (0, "v0 V0, v0"), (50, "!!")]
    docs = [(k, " ".join(rng.choice([*words, "zz", "V1,"]) for _ in range(rng.randrange(60)))) for k in range(40)]
    b, d = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(docs, SCHEMA).unionByName(odd)
    pats = {}
    for i, t in bench:
        w = ALNUM.findall((t or "").translate(LOWER))
        if i is not None and w:
            m = min(8, len(w))
            for k in range(len(w) - m + 1):
                pats.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    for size, slab in ((5, 10), (5, 10**4), (10**6, 10)):
        got = decontaminate.summary(decontaminate.search(d, b, part_words=size, slab_bytes=slab)).collect()
        want = []
        for i, t in [*docs, *ODD]:
            w = ALNUM.findall((t or "").translate(LOWER))
            hit, items = set(), set()
            for p, names in pats.items():
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit.update(range(k, k + len(p)))
                        items |= names
            want.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), len(items) >= 2))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert rows(decontaminate.summary(decontaminate.search(empty, b))) == []
    assert all(r.n_items == 0 for r in decontaminate.summary(decontaminate.search(d, b.limit(0))).collect())


def test_lines(spark, odd, empty):
    rng = random.Random(2)
    pool = ["A shared line of enough length", "  a SHARED line of enough length\t", "another line, long enough to count", "short", "", "ünïcode line exactly 20"]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for k in range(25)] + [(3, "A shared line of enough length"), (30, pool[0] + "\r\n" + pool[0])]
    d = spark.createDataFrame(docs, SCHEMA)
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    where = {}
    for i, t in docs:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                where.setdefault(key(x), set()).add(i)
    want = []
    for i, t in docs:
        lines = t.split("\n")
        stay = [x for x in lines if len(where.get(key(x), ())) < 3 or max(where[key(x)]) == i]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    for batches in (1, 4):
        assert rows(line_dedup.dedup_lines(d, batches=batches), "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=repr)
    got = line_dedup.dedup_lines(odd.selectExpr("*", "1 as id", "2 as key")).collect()
    assert len(got) == len(ODD) and all(r.n_dropped == 0 and r.kept_text == (r.text or "") for r in got)
    assert rows(line_dedup.dedup_lines(empty)) == []


def test_licenses(spark, odd, empty):
    notice = next(iter(license_scan.NOTICES))
    docs = [(101, "The MIT\nLicense, and mit license mit license"), (102, "license mit"), (103, "x " * 31 + "GNU General, Public License " + "y " * 40 + "apache license"), (104, "pad " * 50 + notice.upper() + " pad" * 50), (105, " ".join(notice.split()[:10])), (106, None), (106, None)]
    d = spark.createDataFrame(docs, SCHEMA).unionByName(odd)
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan(d)).collect()}
    for i, t in [*docs, *ODD]:
        w = ALNUM.findall((t or "").translate(LOWER))
        places, labels = [], set()
        for p, label in license_scan.PHRASES.items():
            p = p.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[104].labels == "mit" and got[104].score == 1.0 and got[105].labels == ""
    # every template with enough common words in a block is found
    rng = random.Random(3)
    vocabulary = sorted({w for x in license_scan.NOTICES for w in x.split()})
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(150)))) for k in range(30)]
    long = next(x for x in license_scan.NOTICES if len(x.split()) > 100)
    docs += [(40, f"{'pad ' * 700} {long} {'pad ' * 300}"), (41, " ".join(w for k, w in enumerate(long.split()) if k % 9))]
    found = {r.doc_id: {(m.name, m.block) for m in r.matches if not m.base} for r in license_scan.scan(spark.createDataFrame(docs, SCHEMA), threshold=0.5).collect()}
    for i, t in docs:
        w = t.split()
        want = set()
        for name in license_scan.NOTICES:
            own = set(name.split())
            half = 32 << license_scan.class_of(len(name.split()))
            for b in range(len(w)):
                if b * half < len(w) and len(own & set(w[b * half : (b + 2) * half])) >= 0.5 * len(own):
                    want.add((name, b))
        assert found[i] == want
    assert any(name == long for name, _ in found[40]) and any(name == long for name, _ in found[41])
    assert rows(license_scan.summary(license_scan.scan(empty))) == []


def test_exact(spark, odd, empty):
    got = exact_dedup.mark(odd).collect()
    texts = {}
    for i, t in ODD:
        texts.setdefault(t or "", []).append(i)
    for r in got:
        group = next(v for t, v in texts.items() if sha(t) == r.text_sha256)
        keep = max((i for i in group if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), r.doc_id == keep)
    assert len(got) == len(ODD)
    kept = exact_dedup.dedup(odd.selectExpr("*", "'x' as digest", "1 as id"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted((max((i for i in v if i is not None), default=-1)) for v in texts.values())
    assert rows(exact_dedup.mark(empty)) == [] and rows(exact_dedup.dedup(empty)) == []


def test_near(spark, odd, empty):
    rng = random.Random(5)
    docs, n = [], 0
    for _ in range(6):
        base = [f"t{rng.randrange(5000)}" for _ in range(rng.choice([5, 40, 120]))]
        for _ in range(rng.choice([1, 4, 25])):
            own = [w if rng.random() > 0.03 else f"u{rng.randrange(9999)}" for w in base]
            docs.append((n := n + 1, " ".join(own) if rng.random() > 0.2 else " ".join(own).upper()))
    docs += [(900, "one two"), (901, "One  TWO"), (902, None), (902, ""), (903, docs[0][1])]
    for size in (4, 5):
        sets = []
        for i, t in docs:
            w = WORD.findall((t or "").translate(LOWER))
            sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
        comp = list(range(len(sets)))

        def root(x, comp=comp):
            while comp[x] != x:
                x = comp[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    comp[root(a)] = root(b)
        least = {}
        for k, (i, _) in enumerate(sets):
            least[root(k)] = min(least.get(root(k), i), i)
        want = sorted(((i, len(s), least[root(k)], i == least[root(k)]) for k, (i, s) in enumerate(sets)), key=repr)
        d = spark.createDataFrame(docs, SCHEMA)
        assert rows(near_dedup.summary(d, size)) == want
        assert {r.doc_id for r in near_dedup.dedup(d.selectExpr("*", "1 as id", "2 as t"), size).collect()} == {i for i, _, _, k in want if k}
    got = {r.doc_id: r.component_id for r in near_dedup.summary(odd).collect()}
    assert got[6] == 5 and got[1] == 1 and got[None] is None
    assert rows(near_dedup.summary(empty)) == []


def test_near_pairs_across(spark):
    """Groups whose links do not all go through one pivot."""
    rng = random.Random(8)
    chain = [f"c{k}" for k in range(100)]
    docs = []
    for k in range(30):
        docs.append((k, " ".join(chain)))
        for _ in range(3):
            chain[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
    d = spark.createDataFrame(docs, SCHEMA)
    shingles = {i: {tuple(t.split()[k : k + 4]) for k in range(97)} for i, t in docs}
    comp = {}
    for i in range(30):
        near = [j for j in range(i) if 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j])]
        low = min([i, *(comp[j] for j in near)])
        merged = {comp[j] for j in near}
        comp = {k: low if v in merged else v for k, v in comp.items()} | {i: low}
    assert {r.doc_id: r.component_id for r in near_dedup.summary(d, 4).collect()} == comp


def greedy(word, vocabulary, longest):
    i = n = 0
    while i < len(word):
        size = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in vocabulary), 0)
        n += 1 if size else len(word[i].encode())
        i += size or 1
    return n


def test_token_counts(spark, odd, empty):
    rng = random.Random(6)
    for _ in range(200):
        v = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))}
        a = token_counts.Automaton(v)
        for _ in range(20):
            w = "".join(rng.choice("abcdé") for _ in range(rng.randrange(12)))
            assert a.count(w) == greedy(w, v, 5)
    v = set(token_counts.read_vocabulary(sentence_pieces.MODEL))
    for r in token_counts.count_tokens(odd, v).collect():
        w = WORD.findall(r.text or "")
        memo = {x: greedy("▁" + x, v, 16) for x in set(w)}
        assert (r.n_words, r.n_tokens) == (len(w), sum(memo[x] for x in w))
    assert rows(token_counts.token_totals(empty, v)) == []


def test_substrings(spark, odd, empty):
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(80)]
    docs = [(k, " ".join([rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(rng.randrange(50))] + (passage[(a := rng.randrange(40)) : a + rng.randrange(20, 60)] if k % 2 else []) + [str(rng.randrange(9)) for _ in range(10)])) for k in range(40)]
    docs += [(50, " ".join(["same"] * 60)), (51, " ".join(["same"] * 35)), (52, docs[1][1]), (52, docs[1][1])]
    docs += ODD[:5] + ODD[7:]
    for window, cell in ((35, 300), (35, 10**6), (6, 500)):
        got = rows(substring_dedup.mark_repeats(spark.createDataFrame(docs, SCHEMA), window=window, cell_chars=cell, bucket_chars=3000), "doc_id", "n_words", "n_removed", "kept_text")
        starts = {}
        split = [WORD.findall(t or "") for _, t in docs]
        for w in split:
            for k in range(len(w) - window + 1):
                starts[tuple(w[k : k + window])] = starts.get(tuple(w[k : k + window]), 0) + 1
        want = []
        for (i, _), w in zip(docs, split):
            gone = {q for k in range(len(w) - window + 1) if starts[tuple(w[k : k + window])] > 1 for q in range(k, k + window)}
            want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
        assert got == sorted(want, key=repr)
    assert rows(substring_dedup.mark_repeats(empty)) == []


def test_pieces_relaxed_together():
    """Units relaxed side by side, long ones alone, few and many symbols."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    few = ["", " ", "\n\n", "  a  b\n\n c ", "ab\x00 z", "a" * 4000, "the theory of others " * 40, "x\u2581y", *(f"unit{k} " * 3 for k in range(60))]
    many = [*few, "".join(map(chr, range(0x4E00, 0x4E00 + 700))) + " é漢🙂" * 30]
    for texts in (few, many):
        encoder = sentence_pieces.Encoder(sentence_pieces.load())
        for _ in range(2):
            found = sentence_pieces.encoded(encoder, [sentence_pieces.units_of(t) if t else [] for t in texts])
            assert [list(memoryview(x).cast("i")) for x in found] == [m.encode(t) for t in texts]
    assert sentence_pieces.encoded(encoder, [None, []]) == [None, b""]


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "sentence_pieces"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    stays = {i for i, t in text.items() if re.search(r"[^\W\d_]", t or "")}
    keep = {}
    for i in sorted(stays):
        keep[text[i]] = i
    stays = set(keep.values())
    sets = {}
    for i in stays:
        w = WORD.findall(text[i].translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    comp = {}
    for i in sorted(stays):
        near = {comp[j] for j in comp if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        low = min([i, *near])
        comp = {k: low if v in near else v for k, v in comp.items()} | {i: low}
    stays = set(comp.values())
    pats = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = ALNUM.findall(r.text.translate(LOWER))
        pats |= {tuple(w[k : k + min(8, len(w))]) for k in range(max(len(w) - 7, 1)) if w}
    sizes = {len(p) for p in pats}
    words = {i: ALNUM.findall(text[i].translate(LOWER)) for i in stays}
    stays = {i for i in stays if not any(tuple(words[i][k : k + n]) in pats for n in sizes for k in range(len(words[i]) - n + 1))}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == stays and all(r.round_trip for r in got) and len(got) == len(stays)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    assert all(r.tokens == m.encode(text[r.doc_id]) for r in got)
