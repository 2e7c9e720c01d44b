"""title_fuzzy_match takes whole lines of all rows and equals brute force."""

import random

from quillon.operators import layout
from quillon.plans import registry


def test_whole_lines_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    head = "x" * 60
    rows = [(d, i // 4, i, i, (head if i % 3 else "") + "".join(rng.choice("abcdefg ") for _ in range(rng.choice([5, 40, 120])))) for d in (1, 2) for i in range(12)]
    monkeypatch.setattr(registry, "_line_table", lambda spark, sf: spark.createDataFrame(rows, "doc_id long, page int, line_id int, order int, text string"))
    want = {}
    for d, p, _, _, t in rows:
        title = t[:30] + t[32:]
        near = [(101 if x.strip(" ") == title.strip(" ") else layout.ratio(title, x), -o, q, k) for e, q, k, o, x in rows if e == d and abs(q - p) <= 1]
        best = max(near)
        if best[0] >= 75:
            want[d, title, p] = (best[2], best[3], min(best[0], 100))
    got = registry.QUERIES["title_fuzzy_match"](spark, "").collect()
    assert {(r.doc_id, r.title, r.page): (r.found_page, r.line_id, r.ratio) for r in got} == want
