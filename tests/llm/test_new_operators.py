"""Fill-in-middle, personal data and the conversation trie against brute force in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shelfwise.llm import infilling, personal, trie

ODD_TEXTS = [None, "", " ", "one", " lead and  trail \n", "é 漢字 \U0001f600 mixed\twide", "a <P> mark", "<S", "<", "word " * 3000, "x" * 5000, " no break", "\n\n", "a\x00b c"]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, n string, form string, spans string, _tag string")


def rows_of(texts):
    return [(i, t, "x", "y", "z", "t") for i, t in enumerate(texts)]


# -- fill-in-middle ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["even", "walk", "jumps", "one", "two"])
def test_rank_index_is_exact_and_short(shape):
    rng = np.random.default_rng(5)
    steps = {"even": np.full(20000, 6), "walk": rng.integers(1, 12, 20000), "jumps": np.where(rng.random(20000) < 0.01, 5000, 5), "one": np.array([], int), "two": np.array([100000])}[shape]
    offsets = np.concatenate(([0], np.cumsum(steps)))
    index = infilling.RankIndex(offsets)
    assert [index[k] for k in range(0, len(offsets), 7)] == offsets[::7].tolist() and index[len(offsets) - 1] == offsets[-1]
    assert index.residual.dtype == np.int8
    assert len(index.first) <= {"even": 1, "walk": 20, "jumps": 450, "one": 1, "two": 2}[shape]


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    ws = TOKEN.findall(text)
    n = len(ws)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(ws[:a]), "".join(ws[a:z]), "".join(ws[z:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infilling_equals_brute_force_and_restores(spark, monkeypatch):
    rng = random.Random(3)
    texts = ODD_TEXTS * 6 + ["".join(rng.choices("ab <PSM>é\n ", k=rng.randrange(60))) for _ in range(300)]
    rows = [*rows_of(texts), (None, "no id here", *"abcd"), (7, "one again", *"abcd"), (7, "one again", *"abcd")]
    made = infilling.fill_in_middle(docs_of(spark, rows))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=repr)
    assert got == sorted(((d, *plain_cut(d, t)) for d, t, *_ in rows), key=repr)
    assert {"plain", "spm", "psm"} <= {x[2] for x in got}
    back = sorted((r.doc_id, r.restored_sha256) for r in infilling.infilling_digests(made).collect() if r.doc_id is not None)
    assert back == sorted((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows if d is not None)
    assert infilling.fill_in_middle(docs_of(spark, [])).collect() == []


# -- personal data ----------------------------------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(x.isdigit() and int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def found(spark, texts):
    rows = personal.personal_data(docs_of(spark, rows_of(texts))).collect()
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in rows}, {r.doc_id: r.spans for r in rows}


def test_personal_base_spans_equal_brute_force(spark):
    rng = random.Random(8)
    bits = ["a@b.c", "@", ".", "..", "x_y@z-w.org.uk", "1.2.3.4", "300.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "+44 ", "12", "-", " ", "é", "漢", "\n", "_", "(", ")", "7", "00", "\U0001f600"]
    texts = ODD_TEXTS + ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(800)]
    texts += ["a@b.c_d@e.f a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "0" * 30 + "1.1.1.1", "9" * 3000, "1 2" * 3000, "ab.c" * 4000 + "@x.y", "a@" + "b." * 5000 + "c", "+1" + "(" * 4000 + "2", " ".join(["u@v.w", "8.8.8.8", "+49 30 1234567"] * 700)]
    got, _ = found(spark, texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in PLAIN] == plain_spans(t), t
    assert len(got) == len(texts)


def test_account_numbers_and_lines(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 AND MORE", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 01", "Tel: 030 1234 5678 today", "serial 030 1234 5678 today", "phone +49 030 1234 5678"]
    got, spans = found(spark, texts)
    assert got[0] == [("iban", 5, 32)] and got[1] == [("iban", 0, 22)] and got[2] == []
    assert got[3] == [("line", 5, 18)] and got[4] == [] and got[5] == [("phone", 6, 23)]
    assert spans[0][0].score == 1.0 and spans[1][0].score == pytest.approx(0.8) and spans[5][0].score == 1.0


def test_personal_tables_of_odd_rows(spark):
    rows = [(None, "u@v.w", *"abcd"), (1, "u@v.w", *"abcd"), (1, "u@v.w", *"abcd"), (2, None, *"abcd")]
    made = personal.personal_digests(personal.personal_data(docs_of(spark, rows))).collect()
    assert sorted((r.n_email, r.spans) for r in made) == [(0, ""), (1, "email:0:5"), (1, "email:0:5"), (1, "email:0:5")]
    assert personal.personal_data(docs_of(spark, [])).collect() == []


# -- conversation trie ------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        full = tuple(own.get(rest, [])[:h] + turns[h:])
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
        ends[full].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = []

    def visit(k):
        leaves, saved = 0, (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        for x in children[k]:
            a, b = visit(x)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves, saved, digest))
        return leaves, saved

    if members:
        visit(())
    return sorted(out, key=repr)


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "conv_id bigint, turn bigint, role string, text string, head string, ids string")


def random_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-120, -100), *range(n), 500, 505, 777, 2**40 + 3]:
        for t in range(rng.choice((0, 1, 2, 3, 5, 9))):
            rows.append((c, rng.choice((t, t, t, None)), rng.choice(("user", "assistant", None)), rng.choice(("", "a", "bb", "ccc", None, "é漢"))))
    return rows + rows[:5] + [(None, 0, "user", "lost"), (None, None, None, None)]


@pytest.mark.parametrize("limit", [1, 7, 20_000])
def test_trie_equals_brute_force(spark, limit):
    rows = random_turns(4, 150)
    made = trie.prefix_trie(trie.rebuilt_conversations(turns_of(spark, rows)), limit)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == plain_trie(rows)


@pytest.mark.parametrize("limit", [3, 40])
def test_trie_of_copies_and_deep_openings(spark, limit):
    rows = [(c, t, "user", f"{t}" if t < 40 - c % 7 else f"{c % 5}-{t}") for c in range(300, 330) for t in range(40)]
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(6)] + [(2000, t, "user", str(t)) for t in range(900)]
    made = trie.prefix_trie(trie.rebuilt_conversations(turns_of(spark, rows)), limit)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == _deep(plain_trie, rows)


def _deep(f, rows):
    import sys

    sys.setrecursionlimit(10_000)
    return f(rows)


def test_trie_of_no_rows(spark):
    assert trie.prefix_trie(trie.rebuilt_conversations(turns_of(spark, []))).collect() == []
    only = trie.prefix_trie(trie.rebuilt_conversations(turns_of(spark, [(505, 0, "user", "x")]))).collect()
    assert [tuple(r) for r in only] == plain_trie([(505, 0, "user", "x")])
