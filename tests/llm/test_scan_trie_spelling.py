"""License scans, the prefix trie and spelling variants: edge cases and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlab.llm import bidirectional, licenses, spelling, tour, trie
from flowlab.llm.common import NO_ID

SCHEMA = "doc_id long, text string, lang string, id string, th string, n long, word string, template int, `_id` int"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "x", "y", 1, "w", 2, 3) for i, t in zip(ids, texts)], SCHEMA)


# --- license scans ---


def brute_licenses(text):
    """Phrases word by word; a notice when close places of its pairs cover enough of it."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, lowered)
    places, labels, best, base = [], set(), 0.0, set()
    for k, phrase, label, content in licenses._numbered():
        target = content.split(" ")
        starts = defaultdict(set)  # diagonal: template words covered
        for p in range(len(words) - 1):
            for t in range(len(target) - 1):
                if words[p : p + 2] == target[t : t + 2]:
                    starts[p - t] |= {t, t + 1}
        if phrase:
            here = [p for p in range(len(words)) if words[p : p + len(target)] == target]
            places += here
            if here:
                base.add(label)
        group, last = set(), None
        for d in sorted(starts):
            if last is not None and d - last > licenses.SLACK:
                group = set()
            group, last = group | starts[d], d
            best = max(best, len(group) / len(target))
            if not phrase and len(group) / len(target) >= licenses.COVERED:
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), best


NOTICE = dict((text, label) for label, text in licenses.NOTICES)
MIT = next(t for t, label in NOTICE.items() if label == "mit-notice" and len(t.split()) > 10)


def edited(text, seed):
    rnd = random.Random(seed)
    words = text.split()
    for _ in range(2):
        spot = rnd.randrange(len(words))
        words[spot : spot + rnd.randrange(2)] = ["other"] * rnd.randrange(2)
    return " ".join(words)


LICENSED = [
    "", None, " \n", "!!!", "cc", "CC BY", "cc by cc by", "MIT  License, mit-license; Mit\tLICENSE", "GNU General Public License",
    "GNU Lesser General Public License v3", "gnu general\x00public license", "Lizenz é日本 apache license", "apachelicense apache license2",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0.",
    MIT, "x " * 50 + edited(MIT, 1), edited(MIT, 2) + " " + edited(MIT, 3), " ".join(reversed(MIT.split())), "the license of the " * 500,
    "mit license " * 20_000, " ".join(random.Random(5).choices(" ".join(NOTICE).split(), k=3000)),
]


def test_license_scan_matches_brute_force(spark):
    df = table(spark, LICENSED)
    rows = {r.id: r for r in licenses.scan_licenses(df).collect()}
    assert len(rows) == len(LICENSED)
    for k, text in enumerate(LICENSED):
        r = rows[k]
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        expected = brute_licenses(text)
        assert got == expected[:6], (k, got, expected)
        assert r.score == pytest.approx(expected[6])
    assert rows[21].n_base == 20_000
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_scan_of_repeated_rows_and_null_ids(spark):
    df = table(spark, ["Apache License"] * 300 + ["mit license", None], [None] * 200 + [7] * 100 + [7, 7])
    rows = Counter((r.id, r.n_base, r.labels) for r in licenses.scan_licenses(df).collect())
    assert rows == {(NO_ID, 1, "apache"): 200, (7, 1, "apache"): 100, (7, 1, "mit"): 1, (7, 0, ""): 1}


def test_license_scan_runs_no_python(spark):
    plan = licenses.scan_licenses(table(spark, LICENSED))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!Scan)", plan)


def test_templates_fit_a_mask():
    assert all(1 < len(t.split()) <= licenses.MOST_WORDS for _, t in licenses.PHRASES + licenses.NOTICES)


# --- list ranking ---


@pytest.mark.parametrize("order", ["near", "shuffled", "strided"])
def test_ranked_lists(spark, order):
    """Several lists whose numbers follow the order closely, not at all, or jump between blocks at every step."""
    n, rnd = 3000, random.Random(order)
    names = list(range(n))
    if order == "shuffled":
        rnd.shuffle(names)
    elif order == "strided":
        names = [k for r in range(50) for k in range(r, n, 50)]
    after = {}
    for lo, hi in ((0, 1), (1, 900), (900, n)):
        for a, b in zip(names[lo:hi], [*names[lo + 1 : hi], None]):
            after[a] = b
    rows = [(k, after[k], 1, k % 7) for k in range(n)]
    links = spark.createDataFrame(rows, "element long, next long, steps long, weight long")
    got = {r.element: (r.steps, r.weight) for r in tour.ranked(links, ["steps", "weight"], block=64).collect()}
    expected = {}
    for lo, hi in ((0, 1), (1, 900), (900, n)):
        steps = weight = 0
        for k in reversed(names[lo:hi]):
            steps, weight = steps + 1, weight + k % 7
            expected[k] = (steps, weight)
    assert got == expected


def test_numbered_has_no_gaps(spark):
    df = spark.range(1000, numPartitions=7).selectExpr("id % 3 AS a", "id")
    rows = tour.numbered(df, "a", F.desc("id")).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(1000))
    assert [(r.a, r.id) for r in rows] == sorted(((i % 3, i) for i in range(1000)), key=lambda x: (x[0], -x[1]))
    assert sorted(r.number for r in tour.numbered(df).collect()) == list(range(1000))


# --- prefix trie ---

TURNS = "conv_id long, turn int, role string, text string, v long, rank string, depth int"


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, digest, (role, text)))
    said = {c: [x[-1] for x in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(said.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = {}
    for prefix, inside in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        ends = sorted(c for c in inside if len(rebuilt[c]) == len(prefix))
        out[min(inside), len(prefix)] = (
            min(members[prefix[:-1]]) if prefix else None,
            len(inside),
            len(kids),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            len(below),
        )
    return out


def conversations():
    rnd = random.Random(8)
    first = [("user", "hello"), ("user", "hé日 hello"), ("system", "be kind")]
    rows = []
    for c in [*range(0, 260), 1000, 1007, 5001, -3, -150, 10**12]:
        for turn in range(rnd.choice([1, 2, 3, 7, 9])):
            role, text = first[0] if turn == 0 and c % 3 else rnd.choice([*first, ("assistant", "ok"), (None, None), ("", "")])
            rows.append((c, None if turn == 0 and c % 11 == 0 else turn, role, text))
    rows += [(200, 1, "user", "again"), (200, 1, "user", "again"), (200, 1, "assistant", "tie")]  # ties and a repeated row
    rows += [(None, k, "user", "nobody's") for k in range(30)]
    rows += [(77, 100 + k, "user", f"t{k % 3}") for k in range(300)]  # longer than a block
    return rows


def as_rows(result):
    return {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256, r.n_nodes)
        for r in result.collect()
    }


@pytest.mark.parametrize("small", [True, False])
def test_trie_matches_brute_force(spark, monkeypatch, small):
    if small:  # every bound is met
        monkeypatch.setattr(trie, "PIECE", 16)
        monkeypatch.setattr(trie, "IDS", 4)
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)
    got = as_rows(trie.prefix_trie(df, block=128 if small else tour.BLOCK))
    assert got == brute_trie(rows)


def test_trie_of_copies_and_of_nothing(spark):
    """All conversations of a hundred are one path with all ends at one node."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(6)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)
    got = as_rows(trie.prefix_trie(df))
    assert got == brute_trie(rows) and len(got) == 7
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert trie.prefix_trie(df.where("conv_id < 0")).count() == 0
    alone = as_rows(trie.prefix_trie(df.where("conv_id = 5")))  # its hundred's first conversation is absent
    assert alone == brute_trie([r for r in rows if r[0] == 5])


# --- spelling variants ---


def one_error(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def made_words(seed, n, letters="abé", low=6, high=9):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choices(letters, k=rnd.randint(low, high))) for _ in range(n)})


@pytest.mark.parametrize("entries", [1 << 24, 500])
def test_half_search_matches_brute_force(monkeypatch, entries):
    monkeypatch.setattr(bidirectional, "TABLE", entries)  # small: counts are kept for every 32nd place or so
    monkeypatch.setattr(bidirectional, "BLOCK", 100)
    words = made_words(1, 700)
    coded = [np.array(["abé".index(c) + 1 for c in w], np.int64) for w in words]
    symbols, starts = bidirectional.flat(coded)
    split = np.diff(starts) // 2
    query, near = bidirectional.Vocabulary(coded, 4).near(symbols, starts, split)
    got = list(zip(query.tolist(), near.tolist()))
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if b.startswith(a[: len(a) // 2]) and one_error(a, b)}


@pytest.mark.parametrize("shard", [8192, 20])
def test_near_words_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)  # small: many shards, and halves that are divided
    rnd = random.Random(3)
    words = {w: rnd.choice([5, 6, 30, 200]) for w in [*made_words(2, 500), *made_words(4, 200, "ab", 6, 12), "x" * 3000, "x" * 2999, "é" * 6, "é" * 7]}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form_n, r.form) for r in spelling.near_words(df).collect()}
    for word in words:
        near = [w for w in words if one_error(word, w)]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        assert got.get(word) == ((len(near), words[best], best) if near else None), word


def brute_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def spoken():
    rnd = random.Random(6)
    words = made_words(7, 60, "abcdÉé", 4, 9) + ["letters", "Letters", "letterss", "leters", "straße", "naïveté×÷"]
    texts = [" ".join(rnd.choices(words, [1 / (k + 1) for k in range(len(words))], k=rnd.randint(0, 200))) for _ in range(400)]
    texts += ["letters_Letters9LETTERS-lettersİletters", "ab" * 20_000, "", None, " 12 !", "letters " * 5000]
    ids = [*range(len(texts) - 3), None, None, 3]  # null ids and a repeated one
    rows = list(zip(ids, texts))
    return rows + rows[:50]


def test_a_run_read_as_another_misread_one_changes_once(monkeypatch):
    """Every run is misread here, so what one is read as may be a run that comes later."""
    monkeypatch.setattr(spelling, "MISREAD", 1)
    letters = "a" * 9
    text = " ".join([letters, letters, letters[:8], letters[:7]])
    assert spelling.document_words(3, text) == {"a" * 8: 2, "a" * 7: 1, "a" * 6: 1}


def test_pieces_of_a_half_in_one_shard_answer_a_word_once():
    """A half divided over two pieces that were dealt to one shard: its word asks in both and has one near word."""
    rows = [("abcdef", 9, 3, True, True), ("abcdef", 9, 3, True, False), ("abcdeg", 50, 3, True, True), ("abcdeg", 50, 3, True, False)]
    shard = pa.table({"side": pa.array([0] * 4, pa.int32()), **{c: [r[k] for r in rows] for k, c in enumerate(["word", "n", "part", "asks", "indexed"])}})
    got = sorted(spelling._answered(shard).to_pylist(), key=lambda r: r["word"])
    assert [(r["word"], r["n_near"], r["form_n"], r["form"]) for r in got] == [("abcdef", 1, 50, "abcdeg"), ("abcdeg", 1, 9, "abcdef")]


def test_vocabulary_matches_brute_force(spark):
    rows = spoken()
    df = table(spark, [t for _, t in rows], [i for i, _ in rows])
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == brute_vocabulary(rows)


def test_a_task_gives_out_its_words_when_it_holds_too_many(monkeypatch):
    rows = spoken()
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [t for _, t in rows]})
    whole = list(spelling._spoken(iter([batch])))
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    parts = list(spelling._spoken(iter([batch])))
    assert len(whole) == 1 and len(parts) > 10

    def totals(batches):
        counts = Counter()
        for b in batches:
            counts.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        return counts

    assert totals(whole) == totals(parts)


def test_spelling_variants_match_brute_force(spark):
    rows = spoken()
    df = table(spark, [t for _, t in rows], [i for i, _ in rows])
    words = brute_vocabulary(rows)
    forms = {}
    for word, n in words.items():
        best = min((w for w in words if one_error(word, w)), key=lambda w: (-words[w], w), default=None)
        if best and words[best] >= 5 * n:
            forms[word] = best
    got = {r.word: r for r in spelling.spelling_variants(df).collect()}
    assert set(got) == set(words) and forms
    for word, r in got.items():
        root = word
        while root in forms:
            root = forms[root]
        assert (r.n, r.form, r.root, r.form_n) == (words[word], forms.get(word), root, words.get(forms.get(word)))
        assert r.n_near == sum(one_error(word, w) for w in words)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_roots_follow_long_paths(spark):
    chain = [f"w{k:02d}" for k in range(20)]
    df = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {r.word: r.root for r in spelling._roots(df).collect()} == dict.fromkeys(chain[:-1], "w19")
