"""Queries over whole tables and texts, against brute force."""

import re

from shelfwise.plans import catalog, queries

SF = "/root/testdata/sf0.001"


def test_name_tokens_reads_whole_texts(spark):
    texts = {r.doc_id: r.text for r in catalog.table(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in queries.name_tokens(spark, SF).collect()}
    assert got.keys() == texts.keys()
    plain = {i: t for i, t in texts.items() if t and t.isascii()}
    assert any(len(t) > 5000 for t in plain.values())
    for i, t in plain.items():
        want = sorted({w for w in re.sub("[^a-z0-9]", " ", t.lower()).split() if len(w) > 1})
        assert got[i].tokens == " ".join(want) and got[i].n_tokens == len(want)


def test_price_history_has_every_product(spark):
    kinds = {r.product_id: r.kind for r in catalog.products(spark, SF).select("product_id", "kind").collect()}
    rows = sorted(queries.price_periods(spark, SF).collect(), key=lambda r: (r.store, r.product_id, r.first_seen, r.period))
    held = []
    for r, after in zip(rows, [*rows[1:], None], strict=True):
        last = after is None or (after.store, after.product_id) != (r.store, r.product_id)
        if r.available and r.price_cents is not None:
            held.append((kinds[r.product_id], r.store, r.first_seen, r.last_seen if last else after.first_seen, last, r.price_cents, r.product_id))
    assert max(h[6] for h in held) > 40
    days = {(h[0], h[2]) for h in held}
    of_kind = {}
    for h in held:
        of_kind.setdefault(h[0], []).append(h)
    want = {}
    for kind, day in days:
        for _, store, start, until, last, price, product in of_kind[kind]:
            if start <= day and (day < until or (last and day == until)):
                key = kind, day, store
                want[key] = min(want.get(key, (price, product)), (price, product))
    got = {(r.kind, r.day, r.store): (r.price_cents, r.product_id) for r in queries.price_history(spark, SF).collect()}
    assert got == want


def test_parsed_sizes_has_the_refused_rows(spark):
    sizes = {r.p_partkey: r.p_size for r in catalog.table(spark, SF, "part").collect()}
    got = {r.p_partkey: r for r in queries.parsed_sizes(spark, SF).collect()}
    assert got.keys() == sizes.keys()
    small = [got[k] for k, n in sizes.items() if n in (1, 5, 9)]
    assert small and all((r.total, r.unit, r.pack_count) == (None, None, None) for r in small)
