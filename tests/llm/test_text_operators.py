"""Edge cases and brute-force comparisons of the text operators."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowlab.llm import chat, exact, fingerprint, language, lexicon, near, packing, sharding, substring, urls
from flowlab.llm.fmindex import FmIndex
from flowlab.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, th string, value int, `_id` int"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, 2) for i, t in zip(ids, texts)], SCHEMA)


WORDS = [f"word{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


AWKWARD = ["", None, "   \n", "one", prose(1, 60), prose(1, 60), prose(1, 60) + " tail", "é日本 <|endoftext|> x", prose(2, 30_000), "!!!"]


@pytest.fixture(scope="module")
def awkward(spark):
    df = table(spark, AWKWARD)
    extra = table(spark, [prose(1, 60), None], [4, None])  # a repeated row and a null id
    return df.union(extra)


def test_exact_groups(spark, awkward):
    rows = exact.exact_groups(awkward).collect()
    assert len(rows) == len(AWKWARD) + 2
    by = {(r.id, r.kept) for r in rows if r.id == 4}
    assert by == {(4, True), (4, False)}
    assert [r.kept for r in rows if r.id == 5] == [False]
    assert {r.keep_id for r in rows if r.id in (0, 1, 2)} == {2}
    assert exact.exact_groups(awkward.limit(0)).count() == 0


def test_exact_groups_survive_hash_collisions(spark):
    texts = [prose(k, 300) for k in range(6)] * 2
    rows = exact.exact_groups(table(spark, texts), hasher=lambda c: bytes([len(c) % 2]) * 16).collect()
    assert sorted(r.keep_id for r in rows) == sorted([*range(6)] * 2)


def test_chunks_depend_on_content():
    data = prose(3, 9000).encode()
    assert b"".join(exact._chunks(data)) == data
    moved = {bytes(c) for c in exact._chunks(b"x" * 700 + data)}
    assert len(moved & set(exact._chunks(data))) > 0.8 * len(exact.chunk_ends(data))


def test_near_classes(spark, awkward):
    rows = {(r.id, r.kept): r for r in near.near_classes(awkward).collect()}
    assert rows[(6, False)].class_id == 4
    assert {r.class_id for r in rows.values() if r.id in (0, 1, 2, 9)} == {0}
    assert sum(r.kept for r in rows.values()) == len({r.class_id for r in rows.values()})
    assert near.near_classes(awkward.limit(0)).count() == 0


def test_alignment_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(1, 40))]
        b = [x for x in a if rng.random() > 0.1]
        b = [rng.randrange(12) if rng.random() < 0.1 else x for x in b]
        want = distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
        assert near.within(np.array(a, np.uint64), np.array(b, np.uint64)) == want


def test_crowded_sketches(spark):
    common = prose(7, 60)
    texts = [common + " " + prose(100 + k, 40) for k in range(40)]
    near_one = texts[3].split()
    near_one[70] = "changed"
    rows = near.near_classes(table(spark, [*texts, " ".join(near_one)])).collect()
    assert {r.class_id for r in rows if r.id in (3, 40)} == {3}
    assert len({r.class_id for r in rows}) == 40


@pytest.mark.parametrize("meeting", [512, 60])
def test_near_recall_on_one_template(spark, monkeypatch, meeting):
    monkeypatch.setattr(near, "MEETING", meeting, raising=False)
    rng = random.Random(8)
    passage = prose(70, 75)
    # own passages of 30 words, of which some texts share 20 with one other: 0.75 and less but for these pairs
    own = [[f"own{k}x{i}" for i in range(30)] for k in range(400)]
    for k in range(0, 400, 5):
        own[k][:20] = own[(k * 7 + 3) % 400][:20]
    texts = [passage + " " + " ".join(w) for w in own]
    words = [np.array([hash(w) & 0xFFFFFFFFFF for w in t.split()], np.uint64) for t in texts]
    parent = list(range(400))
    for y in range(400):
        for x in range(y):
            if near.within(words[x], words[y]):
                lo, hi = sorted((parent[x], parent[y]))
                parent = [lo if p == hi else p for p in parent]
    order = list(range(400))
    rng.shuffle(order)
    got = {r.id: r.class_id for r in near.near_classes(table(spark, [texts[k] for k in order], order)).collect()}
    assert 1 < len(set(parent)) < 400
    assert [got[k] for k in range(400)] == parent


def test_near_link_to_one_member(spark):
    """Each odd text is 0.8 alike only to one member of a large group, in words that no sketch shows."""
    passage = prose(71, 80).split()
    group = [passage + [f"own{k}x{i}" for i in range(20)] for k in range(150)]
    odd = []
    for k in range(30):
        text = passage + [group[k * 5][80 + i] if i in (2, 7, 12, 17) else f"odd{k}x{i}" for i in range(20)]
        text[k : k + 3] = [f"new{k}x{i}" for i in range(3)]
        odd.append(text)
    names = {w: i for i, w in enumerate({w for t in group + odd for w in t})}
    as_array = lambda words: np.array([names[w] for w in words], np.uint64)
    alike = [[k for k, g in enumerate(group) if near.within(as_array(g), as_array(t))] for t in odd[:5]]
    assert alike == [[k * 5] for k in range(5)]
    rows = near.near_classes(table(spark, [" ".join(t) for t in group + odd])).collect()
    assert {r.class_id for r in rows} == {0}


def test_near_link_in_an_overfull_sketch(spark, monkeypatch):
    """Odd texts with scattered edits, each 0.8 alike to one member of a group only: a large sketch is not divided by a
    longer one that they do not share, and several blocks of it meet."""
    monkeypatch.setattr(near, "LARGE", 2, raising=False)
    monkeypatch.setattr(near, "BLOCK", 16)
    passage = prose(72, 80).split()
    group = [passage + [f"own{k}x{i}" for i in range(20)] for k in range(150)]
    odd = []
    for k in range(30):
        text = [f"new{k}x{i}" if (i - k) % 14 < 2 and i < 78 else w for i, w in enumerate(passage)]
        odd.append(text + [group[k * 5][80 + i] if i % 2 or i < 4 else f"odd{k}x{i}" for i in range(20)])
    names = {w: i for i, w in enumerate({w for t in group + odd for w in t})}
    as_array = lambda words: np.array([names[w] for w in words], np.uint64)
    assert all(near.within(as_array(group[k * 5]), as_array(t)) for k, t in enumerate(odd))
    rows = near.near_classes(table(spark, [" ".join(t) for t in group + odd])).collect()
    assert {r.class_id for r in rows} == {0}


def test_signatures_rule_out_no_similar_pair():
    rng = random.Random(9)
    ruled_out = 0
    for _ in range(300):
        a = [rng.randrange(400) for _ in range(rng.randrange(1, 600))]
        b = [x for x in a if rng.random() > 0.15]
        b = [rng.randrange(400) if rng.random() < rng.choice([0.05, 0.15, 0.6]) else x for x in b]
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        x, y = near.signature(a)[None], near.signature(b)[None]
        width = min(x.shape[1], y.shape[1])
        differ = np.bitwise_count(near._folded(x, width) ^ near._folded(y, width)).sum()
        maybe = differ <= near._allowed(np.array([len(a)]), np.array([len(b)]), near.SIMILARITY)[0]
        assert maybe or not near.within(a, b)
        ruled_out += not maybe
    assert ruled_out > 50


def brute_removed(texts):
    seen, out = {}, []
    words = [(t or "").split() for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k : k + 13]), i)
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append(" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("crowded", [5000, 2])
def test_substring_removal(spark, monkeypatch, crowded):
    monkeypatch.setattr(substring, "CROWDED", crowded)
    passage = prose(50, 55)
    texts = [prose(k, 40) + " " + passage + "\t" + prose(k + 500, 30) for k in range(12)] + ["a " * 60, "a " * 40, "", None, passage, prose(9, 13)]
    got = {r.id: r for r in substring.removals(table(spark, texts)).collect()}
    for i, want in enumerate(brute_removed(texts)):
        assert (got[i].kept_text if i in got else " ".join((texts[i] or "").split())) == want
    assert substring.removals(table(spark, [])).count() == 0


def test_fm_index():
    rng = np.random.default_rng(2)
    x = rng.integers(1, 5, 500)
    index = FmIndex(np.append(x, 0), 6)
    x = np.append(x, 0)
    ends = np.arange(6, 500)
    lo, hi, length = index.search(x, ends, 6)
    for k, e in enumerate(ends):
        if length[k] == 6:
            p = x[e - 6 : e]
            want = sum((x[j : j + 6] == p).all() for j in range(495))
            assert hi[k] - lo[k] == want


def test_encoding_equals_library(spark, awkward):
    t = Tokenizer.from_file(tokenizer_path())
    rows = {(r.id): r for r in lexicon.encoded_digests(awkward, tokenizer_path(), words=50).collect()}
    for i, text in enumerate(AWKWARD):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    long = "ab" * 2000 + "the" * 300
    assert lexicon.Encoder(tokenizer_path()).merges.merge([long.encode()])[0].tolist() == t.encode(long).ids


def test_packing(spark, awkward):
    rows = packing.pack(awkward, tokenizer_path()).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(by) <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1
    assert packing.pack(awkward.limit(0), tokenizer_path()).count() == 0


def test_sharding(spark, awkward):
    rows = sharding.assign_shards(awkward).collect()
    assert len(rows) == len(AWKWARD) + 2
    many = sharding.assign_shards(table(spark, [prose(k, 5 + k % 50) for k in range(2000)])).toPandas()
    sizes = many.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() < 1.03 * sizes.mean()
    for _, part in many.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.assign_shards(awkward.limit(0)).count() == 0


def test_fingerprints(spark, awkward):
    rows = fingerprint.edited_fingerprints(awkward).collect()
    assert len(rows) == len(AWKWARD) + 2
    prints = {r.id: r.fingerprint for r in rows}
    assert prints[4] == prints[5] and len(prints[4]) == 4 * fingerprint.SLOTS
    assert set(prints[0]) == {"0"}
    assert fingerprint.edited_fingerprints(awkward.limit(0)).count() == 0


def test_language(spark):
    texts = ["the cat and the dog"] * 20 + ["der hund und die katze"] * 20
    df = spark.createDataFrame([(i, t, "en" if i < 20 else "de", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score int")
    model = language.fit_language_model(df)
    new = spark.createDataFrame([("the dog", 1), ("die katze", 2), (None, 3), ("12 !", 4), ("", 5)], "text string, score int")
    got = [(r.lang_pred, r._score) for r in language.predict_language(new, model).orderBy("score").collect()]
    assert [x for x, _ in got] == ["en", "de", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in got)
    empty = language.fit_language_model(df.limit(0))
    assert {r.lang_pred for r in language.predict_language(new, empty).collect()} == {"und"}


def test_urls(spark):
    pages = ["http://A.example.ORG/es/1", "http://example.org/en/12?x", "http://x.com/fr/", "https://com/de/#a", None, "nothing", "http://bad.net/casino/1", "http://a.com"]
    p = spark.createDataFrame([(i, u, 0) for i, u in enumerate(pages)], "page_id long, url string, rule int")
    many = spark.createDataFrame([(100 + i, f"http://bad.net/casino/{i}", 0) for i in range(30)] + [(200 + i, f"http://ok.net/a/{i}", 0) for i in range(30)], p.schema)
    labels = spark.createDataFrame([(100 + i, 1, 1) for i in range(30)] + [(200 + i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.judge_urls(p.union(many), labels).collect()}
    assert [got[i].rule for i in range(8)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None]
    assert [got[i].verdict for i in range(8)] == ["block", "block", "allow", "block", "allow", "allow", "block", "allow"]
    assert (got[0].host, got[0].path, got[4].host, got[5].path) == ("a.example.org", "/es/1", "", "")
    assert {r.verdict for r in urls.judge_urls(p.limit(0), labels.limit(0)).collect()} == set()


def chat_model(seed):
    rng = np.random.default_rng(seed)
    n = len(chat.STATES)
    return chat.ChatModel(rng.integers(-900, 0, n), rng.integers(-900, 0, (n, n)), tuple(rng.integers(-900, 0, (n, s)) for s in chat.FEATURE_SIZES))


def best_score(model, scores):
    """Score of the best path over all lines, state by state."""
    best = {s: model.start[s] + scores[0][s] for s in range(len(model.start))}
    for line in scores[1:]:
        best = {s: max(best[r] + model.step[r][s] for r in best) + line[s] for s in best}
    return max(best.values())


def path_score(model, scores, path):
    return model.start[path[0]] + model.step[path[:-1], path[1:]].sum() + scores[np.arange(len(path)), path].sum()


def test_chat_blocks_equal_whole():
    model, rng = chat_model(0), np.random.default_rng(1)
    scores = chat.line_scores(model, rng.integers(0, np.prod(chat.FEATURE_SIZES), 90))
    offsets = np.array([0, 30, 31, 75, 90])
    tables, first = chat.block_tables(model, scores, offsets)
    before, last, _ = chat.chain(tables, first[0])
    path = chat.decode_rows(model, scores, offsets, before, last)
    assert path_score(model, scores, path) == best_score(model, scores)


def test_chat_rows_side_by_side():
    model, rng = chat_model(2), np.random.default_rng(3)
    sizes = rng.integers(1, 20, 50)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    scores = chat.line_scores(model, rng.integers(0, np.prod(chat.FEATURE_SIZES), offsets[-1]))
    free = np.full(50, -1)
    path = chat.decode_rows(model, scores, offsets, free, free)
    for a, b in zip(offsets, offsets[1:]):
        assert path_score(model, scores[a:b], path[a:b]) == best_score(model, scores[a:b])


CHAT = "conv_id long, turn long, role string, text string, conv int, block string, `_x` int"


def test_chat_recovers_roles(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", "What is this?" if t % 2 == 0 else "It is a thing.\nMore of it.", 7, "b", 1) for c in range(30) for t in range(6)]
    rows = chat.format_chats(spark.createDataFrame([*turns, (None,) * 7], CHAT)).collect()
    assert sum(r.n_right for r in rows) > 0.9 * sum(r.n_lines for r in rows)
    assert all(r.rendered.startswith("<|") for r in rows if r.conv == 3)


def test_chat_long_conversation_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN_BLOCKS", 3)
    long = [(1, t, "user" if t % 2 == 0 else "assistant", f"What is {t}?" if t % 2 == 0 else f"A thing {t}.\nMore.", 7, "b", 1) for t in range(400)]
    odd = [(None, None, "user", f"line {k}", 0, None, 0) for k in range(20)] + [(2, 0, None, "", 0, None, 0)] * 3 + [(3, -5, "system", "x\n" * 3000, 0, None, 0)]
    df = spark.createDataFrame([*long, *odd], CHAT)
    blocks = chat.line_blocks(chat.transcripts(df)).cache()
    model = chat.fit_chat_model(blocks)
    rows = chat.recover_turns(blocks, model).collect()
    want = {c: sum(len(r.lines) for r in g) for c, g in _by_conv(blocks.collect()).items()}
    assert {c: sum(r.n_lines for r in g) for c, g in _by_conv(rows).items()} == want
    mine = sorted((r for r in rows if r.conv == 1), key=lambda r: (r.piece, r.turn))
    assert [r.turn for r in mine] == sorted(r.turn for r in mine) and mine[0].turn == 0
    ordered = sorted(blocks.filter("conv = 1").collect(), key=lambda r: r.block)
    scores = chat.line_scores(model, np.array([c for r in ordered for c in r.codes]))
    offsets = np.concatenate([[0], np.cumsum([len(r.codes) for r in ordered])])
    ends = {r.block: (r.before, r.last) for r in chat.block_ends(blocks.filter("conv = 1"), model).collect()}
    before, last = (np.array([ends[r.block][k] for r in ordered]) for k in (0, 1))
    path = chat.decode_rows(model, scores, offsets, before, last)
    assert path_score(model, scores, path) == best_score(model, scores)
    assert chat.format_chats(df.limit(0)).count() == 0


def _by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r.conv, []).append(r)
    return out


def test_pipeline_stages(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        docs = out
    kept = {r.doc_id for r in docs.collect()}
    assert 4 in kept and not kept & {0, 1, 2, 5, 9}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() > 0


def test_words_of_library():
    splitter = lexicon.Splitter(public_tokenizers.path("word_bpe_49k.json"))
    letters = list("abcéÈ'stmdrevl0159  .,!\t\n_-") + ["'re", "<|endoftext|>", "日", "Σ", "½", "İ"]
    rng = random.Random(1)
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2000)]
    encoder = lexicon.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = [e.ids for e in splitter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [ids[o[k] : o[k + 1]].tolist() for a, b, ids, o in encoder.encode(pa.array(texts)) for k in range(b - a)]
    assert got == want


def brute_rules(rows, min_count=urls.MIN_COUNT, min_confidence=urls.MIN_CONFIDENCE):
    """All token sets of enough unwanted rows and confidence, without those that hold a smaller one as confident."""
    every = [(frozenset(t), u) for t, u in rows]
    scored = {}
    for k in range(1, 6):
        for chosen in map(frozenset, itertools.combinations(sorted({x for t, _ in every for x in t}), k)):
            inside = [u for t, u in every if t >= chosen]
            if sum(inside) >= min_count and sum(inside) / len(inside) >= min_confidence:
                scored[chosen] = sum(inside) / len(inside)
    return {c: p for c, p in scored.items() if not any(d < c and scored[d] >= p for d in scored)}


def test_mined_rules_decide_like_brute_force(spark):
    """Planted tokens and a planted pair: every labelled row is judged as by the rules found by trying all combinations."""
    rnd = random.Random(4)
    rows = []
    for k in range(600):
        tokens = {f"t{rnd.randrange(9)}" for _ in range(4)} | ({"bad"} if k % 12 == 0 else set())
        unwanted = "bad" in tokens or {"t1", "t2"} <= tokens or rnd.random() < 0.05
        rows.append((sorted(tokens), unwanted))
    found = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, unwanted boolean")).collect()
    assert found and all(r.support >= urls.MIN_COUNT and r.confidence >= urls.MIN_CONFIDENCE for r in found)
    for r in found:
        inside = [u for t, u in rows if set(r.tokens) <= set(t)]
        assert r.support == sum(inside) and r.confidence == pytest.approx(sum(inside) / len(inside))
    expected = brute_rules(rows)
    assert {frozenset(r.tokens): pytest.approx(r.confidence) for r in found} == expected
    assert frozenset({"bad"}) in expected and frozenset({"t1", "t2"}) in expected


def test_repeated_long_urls_end(spark):
    """10,000 equal URLs of 60 query keys, and such of many keys that differ a little, do not list all subsets."""
    long = "http://bad.example/go?" + "&".join(f"key{k}=1" for k in range(60))
    other = ["http://mixed.example/x?" + "&".join(f"m{j}=1" for j in range(40) if j % 7 != k % 7) for k in range(60)]
    clean = [f"http://good{k}.test/page" for k in range(500)]
    every = [long] * 10_000 + other + clean
    pages = spark.createDataFrame(list(enumerate(every)), "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, 0) if "good" in u else (k, 0, 1) for k, u in enumerate(every)], "doc_id long, quality int, toxic int")
    rows = urls.judge_urls(pages, labels).collect()
    assert all(r.verdict == ("allow" if "good" in r.host else "block") for r in rows) and len(rows) == len(every)


def test_support_is_a_count(spark):
    """Eight unwanted URLs of one host are enough among 20,000 labelled ones."""
    rows = [(["h:bad"], True)] * 8 + [([f"h:{k}"], k % 50 == 0) for k in range(20_000)]
    found = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, unwanted boolean")).collect()
    assert [r.tokens for r in found] == [["h:bad"]]


def test_a_rule_of_the_rarest_items_of_long_urls(spark):
    """Fifteen items of one URL: the pair that alone tells unwanted URLs is the least often unwanted of them."""
    common = [f"c{i:02}" for i in range(13)]
    rows = [([*common, "x", "y"], True)] * 8 + [([c, f"f{c}"], True) for c in common]
    rows += [([*common, "x"], False)] * 12 + [([*common, "y"], False)] * 12 + [(["x"], False)] * 40 + [(["y"], False)] * 40
    found = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, unwanted boolean")).collect()
    assert [(r.tokens, r.confidence, r.support) for r in found] == [(["x", "y"], 1.0, 8)]


def test_a_centre_is_sent_once_for_many_pairs(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(near, "_sent", lambda work, bodies, f=near._sent: sent.append(work.count()) or f(work, bodies))
    texts = table(spark, [prose(50 + k % 3, 60) + f" w{k}" for k in range(90)]).selectExpr("id AS x", "doc_id AS node", "text")
    pairs = spark.createDataFrame([(k % 3, k) for k in range(3, 90)], "a long, b long")
    assert near._verified(pairs, near._bodies(texts), 0.8).count() == 87
    assert sent == [87 + 3]


def test_bodies_are_not_shuffled_again(spark):
    bodies = near._bodies(table(spark, ["one two", "three"]).selectExpr("doc_id AS node", "text"))
    assert "Bucketed: true" in bodies.join(spark.range(2).selectExpr("id AS node").hint("merge"), "node")._jdf.queryExecution().toString()


def test_crowded_members_are_joined_once(spark):
    """Sizes, buckets and blocks are read off one written table, not off three joins of the members."""
    from flowlab.session import materialize

    members = materialize(spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 2)], "key long, node long, comp long, words long"), "members")
    word = bytes([1, 0, 0, 0, 2, 0, 0, 0])
    bodies = spark.createDataFrame([(1, word), (2, word)], "node long, body binary")
    met = near._met(members, bodies, 0.8)
    assert not any("/members-" in f for f in met.inputFiles())
    assert [tuple(r) for r in met.collect()] == [(1, 2)]


def test_sketches_are_shuffled_once(spark, capsys):
    """Values that two nodes have are found in the rows that the join reads; the same node twice is one."""
    rows = [(v, n) for v in range(300) for n in range(v % 3)] + [(1000, 7), (1000, 7)]
    shared = near._shared(spark.createDataFrame(rows, "value long, node long"))
    assert sorted(map(tuple, shared.collect())) == sorted((v, n) for v, n in rows if v < 1000 and v % 3 == 2)
    shared.explain()
    assert "ReusedExchange" in capsys.readouterr().out


def test_repeated_rows_have_one_body(spark):
    texts = [(n, f"some words of text {n}") for n in range(40)] + [(3, "some words of text 3")] * 20
    bodies = near._bodies(spark.createDataFrame(texts, "node long, text string").repartition(5))
    assert sorted((r.node, len(r.body)) for r in bodies.collect()) == [(n, 4 * 5) for n in range(40)]
