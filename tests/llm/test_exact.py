"""Problems 3, 4, 6, 7 and 8 against brute force, exact round trips and their edge cases."""

import base64
import itertools
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import lines, mixing, pairs, splitting, tokenize

VOCABULARY = tokenize.DEFAULT_VOCABULARY
ODD = ["", " ", "\n\n", "a" * 5000, "\x00\x1c \u0085 x", "<|endoftext|> <s></s>", "don't  they'll\tgo\r\n", "中文字符 とかな", "👩‍🔬 ok", "​zero", "É́ ﬁ ½ ²", "   a   b\n \n  c", "퟿", "0" * 300]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    tables = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=tables.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(texts):
    flat, counts = tokenize.encoder().encode_texts(texts)
    out, at = [], 0
    for n in counts:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_encoding_of_odd_texts(reference):
    assert _ids([*ODD, None]) == [reference.encode_ordinary(t) for t in ODD] + [[]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_encoding_of_any_text(reference, texts):
    assert _ids(texts) == [reference.encode_ordinary(t) for t in texts]


def test_encode_table(spark, reference):
    rows = [(i, t, "extra") for i, t in enumerate([*ODD, None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = dict(tokenize.encode(df).collect())
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t, _ in rows}
    counted = {r["doc_id"]: r["n_tokens"] for r in tokenize.token_counts(df, ["doc_id"]).collect()}
    assert counted == {i: len(x) for i, x in got.items()}
    assert tokenize.encode(df.limit(0)).count() == 0


# problem 8


def test_schedule_stays_within_one_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05, "e": 0.0}
    done = defaultdict(int)
    for slot, source, block in mixing.pfair_schedule(weights, 400):
        assert block == done[source]
        done[source] += 1
        assert all(abs(done[s] - w * (slot + 1)) < 1 + 1e-9 for s, w in weights.items())
    assert done["e"] == 0 and sum(done.values()) == 400


def _mix(spark, docs, targets, **more):
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    goal = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sized, goal, **more)
    return mixed.collect(), {r["source"]: r for r in mixing.shares(mixed, sized, goal).collect()}


def test_mix_meets_shares_and_repeats(spark):
    docs = [(i, "big", 10) for i in range(3000)] + [(10_000 + i, "small", 10) for i in range(300)] + [(20_000 + i, "tiny", 10) for i in range(10)] + [(30_000, None, 10), (30_001, "other", 5), (30_002, "big", 0)]
    targets = [("big", 0.5, 1), ("small", 0.2, 3), ("tiny", 0.2, 2), ("none", 0.1, 2), ("none", 0.1, 2)]
    rows, shares = _mix(spark, docs, targets, slots=64)
    total = sum(d[2] for d in docs)
    assert abs(shares["big"]["tokens"] - total / 2) <= 10 and abs(shares["small"]["tokens"] - total * 0.2) <= 10
    assert shares["tiny"]["tokens"] == 200 and shares["tiny"]["most_uses"] == 2 and shares["none"]["actual_share"] == 0.0
    uses = defaultdict(int)
    for r in rows:
        uses[r["doc_id"]] += 1
    assert max(uses.values()) <= 3 and not set(uses) & {30_000, 30_001}
    assert len({(r["source"], r["offset"], r["doc_id"]) for r in rows}) == len(rows)
    assert abs(sum(s["actual_share"] for s in shares.values()) - 1) < 1e-9
    # at any point of the mix no source is a block ahead of its share
    size = -(-total // 64)
    by_slot = defaultdict(lambda: defaultdict(int))
    for r in rows:
        by_slot[r["slot"]][r["source"]] += r["n_tokens"]
    seen = defaultdict(int)
    for slot in range(40):
        for s, n in by_slot[slot].items():
            seen[s] += n
        assert all(seen[s] <= w * (slot + 1) * size + size + 10 for s, w in (("big", 0.5), ("small", 0.2)))


def test_schedule_places_every_block_of_small_shares():
    for weights in ({"a": 0.9, "b": 0.0999, "c": 0.0001}, {"a": 0.9} | {f"s{i}": 0.00005 for i in range(2000)}, {"a": 1 - 1e-9, "b": 1e-9, "none": 0.0}):
        blocks = {s: int(w * 4096) + 1 for s, w in weights.items()}
        rows = mixing.pfair_schedule(weights, 4096, blocks)
        placed = defaultdict(list)
        for _, source, block in rows:
            placed[source].append(block)
        assert all(placed[s] == [*range(len(placed[s]))] and len(placed[s]) >= blocks[s] for s, w in weights.items() if w)
        assert len({slot for slot, *_ in rows}) == len(rows) <= 4096 + len(weights) + 1
        # what came within the slots stays where it was
        assert rows[:4096] == mixing.pfair_schedule(weights, 4096)


def test_mix_keeps_small_shares(spark):
    docs = [(i, "big", 10) for i in range(2000)] + [(10_000 + i, "middle", 10) for i in range(400)] + [(20_000 + i, "small", 1) for i in range(30)] + [(30_000, "zero", 0)]
    rows, shares = _mix(spark, docs, [("big", 0.9, 3), ("middle", 0.0995, 9), ("small", 0.0005, 1), ("zero", 0.0, 1)], slots=64)
    total = sum(d[2] for d in docs)
    assert abs(shares["small"]["tokens"] - 0.0005 * total) <= 1 and abs(shares["middle"]["tokens"] - 0.0995 * total) <= 10
    assert shares["zero"]["documents"] == 0


def test_mix_edges(spark):
    assert _mix(spark, [], [("a", 1.0, 1)])[0] == []
    assert _mix(spark, [(1, "a", 3)], [])[0] == []
    rows, _ = _mix(spark, [(1, "a", 0), (2, "a", 0)], [("a", 1.0, 5)])
    assert sorted(r["doc_id"] for r in rows) == [1, 2]
    for bad in ([("a", None, 1)], [("a", -0.5, 1)], [("a", 0.5, 1), ("a", 0.4, 1)]):
        with pytest.raises(ValueError):
            _mix(spark, [(1, "a", 1)], bad)


# problem 4


def _classes(text):
    """The coarsest boundary, straight from the statement."""
    units, unit, fenced, rows = [], [], False, text.split("\n")
    for row in rows:
        if row.strip().startswith(("```", "~~~")):
            fenced = not fenced
        if not row.strip() and not fenced:
            units.append("\n".join(unit))
            unit = []
        else:
            unit.append(row)
    units.append("\n".join(unit))
    sentences = [s for row in rows for s in re.split(r"(?<=[.!?])(?=\s)|(?<=[。！？])", row)]
    for name, parts in (("blank", units), ("line", rows), ("sentence", sentences)):
        if max(map(len, parts), default=0) <= 2200:
            return name
    return "none"


_PIECE = st.sampled_from(["word " * 30, "x" * 700, ". ", "! ", "\n", "\n\n", "\n \n", "\r\n", "```\n", "~~~\n", "。", "é", "？", "end.", " "])


@settings(max_examples=200, deadline=None)
@given(st.lists(_PIECE, min_size=5, max_size=60).map("".join))
def test_split_round_trip(text):
    kind, cuts = splitting.split_text(text)
    if len(text) <= 2400:
        assert kind is None and cuts == [(0, len(text), 4)]
        return
    assert kind == _classes(text)
    assert all(b - a <= 2400 for a, b, _ in cuts) and cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(y[0] == x[1] - 200 for x, y in itertools.pairwise(cuts))
    assert text[: cuts[0][1]] + "".join(text[a + 200 : b] for a, b, _ in cuts[1:]) == text
    if kind != "none":
        assert all(splitting.NAMES.index(kind) <= s for _, _, s in cuts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=90), st.data())
def test_range_maximum(values, data):
    import numpy as np

    index = splitting.RangeMax.placed(np.array(values, np.uint8), len(values))
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a, len(values) - 1))
    assert index.query(a, b) == max((values[i], i) for i in range(a, b + 1))
    width = data.draw(st.integers(1, b - a + 1))
    assert splitting.RangeMax(np.array(values, np.uint8), width).weakest(a, b, width) == min(max(values[i : i + width]) for i in range(a, b + 2 - width))


def test_split_tables(spark):
    long = "A sentence of some length. " * 200
    rows = [(1, "t", long, "x"), (1, "t", long, "x"), (2, "s", "short", "x"), (3, None, "", "x"), (4, "n", None, "x"), (5, "r", "y" * 100_000, "x")]
    df = spark.createDataFrame(rows, "chunk_id bigint, title string, text string, piece_no string")
    got = defaultdict(dict)
    for r in splitting.pieces(df, "chunk_id", ["title"]).collect():
        got[r["chunk_id"]][r["piece_no"]] = r
    assert set(got) == {1, 2, 3, 5} and all(p["title"] == "t" for p in got[1].values()) and got[3][1]["text"] == ""
    for k, text in ((1, long), (5, "y" * 100_000)):
        parts = [got[k][i]["text"] for i in sorted(got[k])]
        assert parts[0] + "".join(p[200:] for p in parts[1:]) == text
    assert splitting.pieces(df.limit(0), "chunk_id", ["title"]).count() == 0


# problem 6


def _brute(sets, other, t, shared, least):
    items = other if other is not None else sets
    out = set()
    for a, b in itertools.product(sets, items):
        x, y = set(sets[a] or ()) - {None}, set(items[b] or ()) - {None}
        if (other is not None or a < b) and min(len(x), len(y)) >= max(1, least) and len(x & y) >= shared and len(x & y) / len(x | y) >= t:
            out.add((a, b))
    return out


def _sets(seed, n, words):
    import random

    r = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = {}
    for i in range(n):
        mine = r.sample(base, r.randint(0, min(12, words)))
        if i and r.random() < 0.4:  # a changed copy
            mine = [w for w in out[r.randrange(i)] or [] if r.random() < 0.8] + r.sample(base, 2)
        if r.random() < 0.5:
            mine.append("hot")  # half of all rows hold this one
        out[i] = None if r.random() < 0.02 else mine + mine[:1]
    return out


@pytest.mark.parametrize(("t", "shared", "least", "ranked"), [(0.34, 3, 3, 20_000), (0.34, 3, 3, 1), (0.8, 1, 1, 3), (0.5, 2, 1, 5), (0.25, 2, 2, 20_000)])
def test_similar_pairs_are_all_there(spark, monkeypatch, t, shared, least, ranked):
    monkeypatch.setattr(pairs, "RANKED", ranked)
    sets = _sets(3, 220, 40)
    df = spark.createDataFrame([*sets.items(), *list(sets.items())[:5]], "id bigint, terms array<string>")
    got = {tuple(r) for r in pairs.expand(*pairs.similar_pairs(df, t, shared, least)).collect()}
    assert got == _brute(sets, None, t, shared, least)


@pytest.mark.parametrize(("t", "shared", "least", "worth"), [(0.34, 3, 3, 0.5), (0.8, 1, 1, 0.5), (0.2, 1, 1, 0.5), (0.34, 3, 3, 9)])
def test_similar_pairs_of_crowded_buckets(spark, monkeypatch, t, shared, least, worth):
    """Buckets of more than a few records are dealt out until they hold links only; long sets are in length classes."""
    monkeypatch.setattr(pairs, "HEAVY", 4)
    monkeypatch.setattr(pairs, "WORTH", worth)
    sets = _sets(5, 100, 24) | ({500 + i: [f"w{j}" for j in range(i, 40 + 2 * i)] for i in range(6)} if worth < 1 else {})
    df = spark.createDataFrame([*sets.items()], "id bigint, terms array<string>")
    got = {tuple(r) for r in pairs.expand(*pairs.similar_pairs(df, t, shared, least)).collect()}
    assert got == _brute(sets, None, t, shared, least)


def test_candidates_grow_with_records_and_links(spark):
    """Three sizes over the same few words, a third of all records with two of them: the work doesn't grow with the square."""
    import random

    r, counts = random.Random(8), []
    for n in (1500, 3000, 6000):
        sets = [(i, r.sample([f"w{j}" for j in range(300)], 10) + (["hot", "hotter"] if r.random() < 0.33 else [])) for i in range(n)]
        df = spark.createDataFrame(sets, "id bigint, terms array<string>")
        hashed = df.select(F.col("id").alias("class"), F.lit(0).alias("side"), F.transform("terms", lambda x: F.xxhash64(x)).alias("h"))
        counts.append(pairs.candidates(hashed, 0.34, 3, {}, False).count())
    assert counts[2] < 6000 * 40 and counts[2] / max(1, counts[0]) < 16


def test_similar_pairs_between_tables(spark):
    left, right = _sets(1, 90, 30), {k + 1000: v for k, v in _sets(2, 90, 30).items()}
    right[2000] = left[3]
    schema = "id bigint, terms array<string>"
    links, classes = pairs.similar_pairs(spark.createDataFrame(list(left.items()), schema), 0.4, 2, 1, other=spark.createDataFrame(list(right.items()), schema))
    of = defaultdict(set)
    for r in classes.collect():
        of[r["side"], r["class"]].add(r["id"])
    got = {(a, b) for r in links.collect() for a in of[0, r["class_a"]] for b in of[1, r["class_b"]]}
    assert got == _brute(left, right, 0.4, 2, 1)


def test_similar_pairs_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, ["a"]), (4, [None])], "id bigint, terms array<string>")
    assert pairs.expand(*pairs.similar_pairs(df, 0.5, 2, 2)).count() == 0
    assert pairs.expand(*pairs.similar_pairs(df.limit(0), 0.5)).count() == 0


# problem 3


def test_line_forms():
    text = "# Heading of some length here\nShare  This page 123 with a­ friend!\n```\nprint a line of code 1 2 3\n~~~\n— By J​ane Doe · 12 min read\nshort\n  #  also a heading of length"
    assert [(n, f) for n, f, _ in lines.forms(text)] == [(2, "share this page 0 with a friend"), (6, "by jane doe · 0 min read")]


def _shingles(words, n=5):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def test_masks_of_dates_and_names():
    sign = lines.Signer()
    same = [
        ["By Jane Doe on 0 March 0 for all", "By Jane van Doe Smith on March 0, 0 for all", "By Ann Lee on 0th of April 0 for all"],
        ["Stand vom 0. März 0 geprüft und gut", "Stand vom 0. Januar 0 geprüft und gut"],
        ["Actualizado el 0 de mayo de 0 por nosotros", "Actualizado el 0 de junio de 0 por nosotros"],
    ]
    for group in same[1:]:
        assert len(set(sign(group)[0].tolist())) == 1, group
    assert sign(["on 0 March 0 for all"])[0] == sign(["on March 0, 0 for all"])[0] == sign(["on 0th of April 0 for all"])[0]
    assert sign(["seen by Jane Doe here"])[0] == sign(["seen by Ann Mary Lee here"])[0] != sign(["seen by Jane here"])[0]
    # a month or a word of dates alone is a word
    assert len(set(sign(["you may go now", "you can go now", "the edge of town here", "the edge de town here"])[0].tolist())) == 4
    assert [len(x) for x in sign([])] == [0, 0, 0, 1]


def test_near_copies_are_found(spark):
    """Recall of near copies of a lead, by exact Jaccard of five-word shingles, for long and for short lines; and nothing below."""
    import random

    r = random.Random(11)
    words = ["".join(p) for p in itertools.product("bdfgklmnprst", "aeiou", "bdfgklmnprst", "aeiou")]
    texts, sources, truth = [], [], {}
    n = 0
    for c in range(240):
        size = r.choice([6, 8, 10, 12, 30, 60, 90, 120])
        lead = r.sample(words, size)
        copy = list(lead)
        if size <= 12:
            copy = copy + [r.choice(words)] if c % 2 else copy[1:]  # a word more at the end, or one less at the front
        else:
            for _ in range(r.randint(1, max(1, size // 40))):
                copy[r.randrange(size)] = r.choice(words)
        a, b = _shingles(lead), _shingles(copy)
        truth[c] = (len(a & b) / len(a | b), size)
        for i in range(9):
            texts.append((n, " ".join(lead if i else copy)))
            sources.append((n, f"s{c % 3}"))
            n += 1
    found = {r_["file_id"] for r_ in lines.repeated_lines(spark.createDataFrame(texts, "file_id bigint, text string"), spark.createDataFrame(sources, "file_id bigint, source string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        near = [9 * c in found for c, (j, _) in truth.items() if low <= j < high]
        assert len(near) >= 10 and sum(near) / len(near) >= 0.9, (low, len(near), sum(near))
    short = [9 * c in found for c, (j, size) in truth.items() if j >= 0.8 and size <= 12]
    assert len(short) >= 20 and sum(short) / len(short) >= 0.9
    assert not any(9 * c in found for c, (j, _) in truth.items() if j < 0.8)


def test_lines_left_alone_find_each_other(spark):
    """Eight copies of a line in two near variants, which share bands with a far more frequent unlike line, are still found."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = [f"common{x}" for x in letters]
    odd = base[:20] + [f"odd{x}" for x in letters[:8]]
    texts = [(i, " ".join(base)) for i in range(40)] + [(100 + i, " ".join(odd + (["tail" + letters[i]] if i else []))) for i in range(8)]
    df = spark.createDataFrame(texts, "file_id bigint, text string")
    rows = lines.repeated_lines(df, df.select("file_id", F.lit("s").alias("source"))).collect()
    assert {r["file_id"] for r in rows} == {i for i, _ in texts}


def test_repeated_lines(spark):
    notice = "All rights reserved, {} words of it."
    texts, sources = [], []
    for i in range(40):
        source = "hot" if i < 30 else f"s{i % 3}"
        body = [notice.format(i) if i % 2 else notice.format(i).upper(), f"own line number {chr(97 + i % 26)}{chr(97 + i // 26)} of this very file", "Download this page as a file to read it offline today or any day after that you like." if i % 5 else "Download this page as a file to read it offline today or any day after that you wish."]
        texts.append((i, "\n".join(body + body[:1])))
        sources.append((i, source))
    texts += [(90, None), (91, ""), (92, "x\n" * 5), (93, notice.format(1)), texts[0]]
    sources += [(90, "hot"), (91, "hot"), (92, "hot"), (93, None), (0, "hot"), (0, "zzz")]
    t, s = spark.createDataFrame(texts, "file_id bigint, text string"), spark.createDataFrame(sources, "file_id bigint, source string")
    rows = lines.repeated_lines(t, s).collect()
    exact = {(r["file_id"], r["line_no"]) for r in rows if r["form_files"] >= 8}
    per, at = defaultdict(set), defaultdict(set)
    chosen = {}
    for f, src in sources:
        if src is not None:
            chosen[f] = min(chosen.get(f, src), src)
    for f, text in dict(texts).items():
        for n, form, _ in lines.forms(text or ""):
            if f in chosen:
                per[chosen[f], form].add(f)
                at[chosen[f], form].add((f, n))
    assert exact == {p for k, files in per.items() if len(files) >= 8 for p in at[k]}
    # the rarer spelling of the offline line has too few files of its own, but lies in the cluster of the other
    near = {(r["file_id"], r["line_no"]) for r in rows}
    assert exact < near | exact and all((i, 3) in near for i in range(30))
    clean = dict(lines.without_lines(t.dropDuplicates(["file_id"]), spark.createDataFrame(rows)).collect())
    assert clean[90] is None and clean[91] == "" and clean[7] == "own line number ha of this very file"
    assert lines.repeated_lines(t.limit(0), s).count() == 0

