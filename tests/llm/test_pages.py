"""Lines that pages share with their nearest by URL."""

import random

from chatloom.llm import pages


def brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def is_subsequence(x, b):
    it = iter(b)
    return all(v in it for v in x)


def test_alignment_equals_brute_force(monkeypatch):
    draw = random.Random(5)
    for cells in (1 << 27, 20):
        monkeypatch.setattr(pages, "CELLS", cells)
        for _ in range(400):
            a, b = ([draw.randrange(draw.choice((2, 6, 30))) for _ in range(draw.randrange(14))] for _ in range(2))
            at = pages.common(a, b)
            assert at == sorted(set(at)) and len(at) == brute(a, b) and is_subsequence([a[i] for i in at], b)


def test_long_pages_are_aligned():
    a, b = [f"line {i % 5000}" for i in range(20_000)], [f"line {i % 4999}" for i in range(20_000)]
    numbers = {x: i for i, x in enumerate(sorted({*a, *b}))}
    got = pages.common([numbers[x] for x in a], [numbers[x] for x in b])
    assert len(got) > 15_000


def test_shared_lines_of_a_host_are_deleted(spark):
    top, foot = "<nav>Home | Blog</nav>", "All rights reserved."
    rows = [(i, f"https://A.example/post/{i:03d}?x=1", f"{top}\nText number {i}.\n\n{foot}", "clash") for i in range(40)]
    rows += [(100, "https://b.example/only", f"{top}\nAlone.\n{foot}", "clash"), (101, None, None, None), (102, "no url", "", None), (103, "https://c.example/1", "same\nsame", ""), (103, "https://c.example/1", "same\nsame", "")]
    df = spark.createDataFrame(rows, "id long, url string, text string, _host string")
    got = {}
    for r in pages.without_shared_lines(df, "url", "text", "id").collect():
        got.setdefault(r["id"], []).append((r["n_shared"], r["rest"]))
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i] in ([(2, f"Text number {i}.\n")], [(0, rows[i][2])]) for i in range(40)) and sum(got[i][0][0] == 2 for i in range(40)) >= 36
    assert got[100] == [(0, rows[40][2])] and got[101] == [(0, None)] and got[102] == [(0, "")] and got[103] == [(2, "")] * 2
    assert pages.without_shared_lines(df.limit(0), "url", "text", "id").count() == 0


def test_differences_of_odd_rows(odd_raw):
    assert pages.message_differences(odd_raw).count() == sum(len([m for t in r["conversation"] or [] for m in t or []]) for r in odd_raw.collect())
