"""Language ID, repeats, passages, Jaccard groups, decontamination and mixing against brute force, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfwise.llm import decontaminate, jaccard, langid, mixing, passages, substrings

WORDS = "amber birch cedar dune ember fjord grove heath inlet jetty knoll ledge marsh north ocean plain quarry ridge shore trail upland vale wharf yarn zenith".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, token string, start string, size long, tag string"
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def frame(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", "x", "x", 1, "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    shared = prose(rng, 70)
    out = list(base)
    for t in base[:12]:
        words = t.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [f"{prose(rng, 20)} {shared} {prose(rng, 25)}" for _ in range(9)] + [base[0]] * 5 + [base[1].upper(), "", None, "  \t\n", "one", "One", "é" * 300, "é" * 300, "ab" * 400, prose(rng, 6000)]
    return list(enumerate(out))


def words_of(text):
    return SPLIT.findall((text or "").encode().lower() if (text or "").isascii() else (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_jaccard_groups_equal_all_pairs(spark, corpus):
    got = {r.doc_id: (r.n, r.component_id) for r in jaccard.jaccard_groups(frame(spark, corpus)).collect()}
    sets = {i: shingles(t) for i, t in corpus}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i, _ in corpus}


def test_keep_one_of_each_group(spark, corpus):
    docs = frame(spark, [*corpus, (3, corpus[3][1])])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = components({i: shingles(t) for i, t in corpus})
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_jaccard_near_threshold(spark):
    rng = random.Random(1)
    texts = []
    for g in range(12):
        core = [f"w{g}x{i}" for i in range(40)]
        texts += [" ".join([*core, *(f"u{g}y{k}z{rng.random()}" for _ in range(k))]) for k in range(0, 14)]
    texts = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(frame(spark, texts)).collect()}
    assert got == components({i: shingles(t) for i, t in texts})


def test_word_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"Alpha beta\talpha BETA\x0balpha", np.uint8)
    h, text = jaccard.word_hashes(data, np.array([0, 10, len(data)]))
    assert len(h) == 5 and h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]
    assert text.tolist() == [0, 0, 1, 1, 1]


def brute_removal(texts, size=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        spans = []
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + b[at:s], e
        out.append((len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_repeats_equal_brute_force(spark, corpus, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings.repeated_spans, "__defaults__", (200, "doc_id", "text", group))
    got = {r.doc_id: tuple(r)[1:] for r in substrings.removal_digests(substrings.remove_repeats(frame(spark, corpus))).collect()}
    want = brute_removal([t for _, t in corpus])
    assert [got[i] for i, _ in corpus] == want


def test_repeated_rows_are_documents_of_their_own(spark):
    text = prose(random.Random(2), 60)
    out = substrings.removal_digests(substrings.remove_repeats(frame(spark, [(1, text), (1, text), (None, "short")]))).collect()
    assert sorted(r.n_removed for r in out) == [0, len(text), len(text)]


def test_compact_windows_are_tree_nodes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, least = int(rng.integers(1, 120)), int(rng.integers(2, 12))
        v, text = rng.integers(1, 1000, n).astype(np.uint64), np.sort(rng.integers(0, 3, n))
        want = set()
        for c in range(n):
            a = b = c
            while a > 0 and text[a - 1] == text[c] and v[a - 1] > v[c]:
                a -= 1
            while b < n - 1 and text[b + 1] == text[c] and v[b + 1] >= v[c]:
                b += 1
            if b - a + 1 >= least:
                want.add((a, c, b))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, text, least)), strict=True)) == want


def test_passages_cover_what_texts_share(spark, corpus):
    found = {r.doc_id: r for r in passages.near_passages(frame(spark, corpus)).collect()}
    where = defaultdict(set)
    texts = {}
    for i, t in corpus:
        texts.setdefault(t, i)
    for t, i in texts.items():
        w = words_of(t)
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    for t, i in texts.items():
        w = words_of(t)
        covered = set()
        for p in found[i].passages if i in found else []:
            covered |= set(range(p.start_word, p.end_word + 1))
            assert p.similarity >= 0.75 and p.other != i
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                assert set(range(k, k + 50)) <= covered
    assert found[0].n_copies == 6


@pytest.mark.parametrize("n, edits", [(50, [2]), (50, [47]), (55, [2, 52]), (60, [3, 56]), (50, [0])])
def test_passages_with_edits_near_their_ends(spark, n, edits):
    rng = random.Random(n + edits[0])
    a = prose(rng, n).split()
    b = ["edited" if k in edits else w for k, w in enumerate(a)]
    p, q = shingles(" ".join(a)), shingles(" ".join(b))
    assert len(p & q) >= 0.75 * len(p | q)
    x, y = (passages.shingle_sequence(np.frombuffer(" ".join(t).encode(), np.uint8), np.array([0, len(" ".join(t))]))[0] for t in (a, b))
    for u, v in ((x, y), (y, x)):
        found = passages.matching_passages(u, v, 46)
        assert found and all(f[1] - f[0] >= 45 and f[3] - f[2] >= 45 and f[4] >= 0.75 for f in found)


def test_passages_that_run_into_a_frequent_line(spark):
    rng = random.Random(23)
    line = prose(rng, 36)
    rows = [(i, f"{prose(rng, rng.randint(20, 60))} {line} {prose(rng, 40)}") for i in range(240)]
    for k in range(60):
        own = prose(rng, 16).split()
        near = ["edited" if k % 2 and i == 8 else w for i, w in enumerate(own)]
        rows += [(1000 + 2 * k, f"{prose(rng, 30)} {' '.join(own)} {line} {prose(rng, 30)}"), (1001 + 2 * k, f"{prose(rng, 25)} {' '.join(near)} {line} {prose(rng, 35)}")]
    rng.shuffle(rows)
    found = {r.doc_id: r.passages for r in passages.near_passages(frame(spark, rows)).collect()}
    sets = {i: passages.shingle_sequence(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for i, t in rows}
    want = {i: {j for j in sets if j != i and passages.matching_passages(sets[i], sets[j], 46)} for i in sets}
    assert all(k ^ 1 in want[k] for k in range(1000, 1120))
    group = {i: {p.group_id for p in x} for i, x in found.items()}
    for i, others in want.items():
        assert bool(others) == (i in found)
        for j in others:
            assert group[i] & group[j]


def test_passages_at_the_threshold_are_met(spark):
    rng = random.Random(29)
    rows = []
    while len(rows) < 600:
        a = prose(rng, 70).split()
        b = list(a)
        for at in rng.sample(range(70), 2):
            b[at] = "edited" + str(rng.randrange(10**6))
        p, q = shingles(" ".join(a)), shingles(" ".join(b))
        if 0.75 <= len(p & q) / len(p | q) <= 0.8:
            rows += [(len(rows), f"{prose(rng, 30)} {' '.join(a)}"), (len(rows) + 1, f"{prose(rng, 20)} {' '.join(b)}")]
    found = {r.doc_id: {p.other for p in r.passages} for r in passages.near_passages(frame(spark, rows)).collect()}
    met = sum(k ^ 1 in found.get(k, ()) for k in range(0, 600, 2))
    print("met", met, "of 300")
    assert met >= 297


def test_decontamination_equals_exact_containment(spark, corpus):
    rng = random.Random(9)
    items = [prose(rng, n) for n in (14, 30, 59, 3, 5)] + [None, ""]
    planted = [(100 + k, f"{prose(rng, 300)} {x.upper() if k else x} {prose(rng, 40)}") for k, x in enumerate(items[:3])]
    half = items[1].split()
    planted += [(110, f"{prose(rng, 9)} {' '.join(half[:20])} {prose(rng, 9)}"), (111, f"zz {' '.join(half[:29])} zz"), (112, items[3]), (113, items[4] + " tail")]
    rows = [*corpus, *planted]
    docs, bench = frame(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    sets, qs = {i: shingles(t) for i, t in rows}, {k: shingles(t) for k, t in enumerate(items)}
    want = {(i, k): len(s & q) for i, s in sets.items() for k, q in qs.items() if q and len(s & q) >= 0.75 * len(q)}
    for threshold in ("10MB", "-1"):  # joins by broadcast and by shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.contaminated(docs, bench).collect()}
        assert got == want and (111, 1) in got and (110, 1) not in got
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}


def fill(sizes, weights, most):
    target, free, left = {}, dict(weights), float(sum(sizes.values()))
    while free:
        total = sum(free.values())
        over = [s for s in free if left * free[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * w / total for s, w in free.items()}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            del free[s]
    return target


def test_mixing_meets_water_filling_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["a", "b", "c", "Z", "", None, "é"]) if rng.random() < 0.5 else "hot") for i in range(600)] + [(1, None, "a"), (1, None, "a"), (700, "x y", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'q' as cell", "2.0 as target")
    out = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    assert len(out) == len(rows)
    for s in order:
        own = [r for r in out if r.source == s]
        assert own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 60
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in out)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_language_id_generalises_and_marks_undetermined(spark):
    rng = random.Random(5)
    alphabets = {"xx": "abcdefgh", "yy": "stuvwxyz"}
    rows = []
    for i in range(300):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, " ".join("".join(rng.choices(alphabets[lang], k=rng.randint(2, 8))) for _ in range(rng.randint(1, 120))), lang))
    rows += [(900, None, "xx"), (901, "123 !?", "xx"), (902, "", None), (None, "abc abd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'z' as lang_pred", "1 as rank")
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, _, lang in rows[:300]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [by[i].lang_pred == lang for i, _, lang in rows[:300] if by[i].held_out]
    assert np.mean(held) > 0.97
    assert [by[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.keep_identified(docs, 0.3).filter("doc_id >= 900").count() == 0


@pytest.mark.parametrize("run", [jaccard.jaccard_groups, substrings.remove_repeats, passages.near_passages, mixing.mix_sources, langid.identify, jaccard.keep_one])
def test_empty_tables_give_empty_results(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_decontamination_of_and_by_nothing(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, corpus), none).count() == 0
    assert decontaminate.contaminated(frame(spark, []), some).count() == 0
