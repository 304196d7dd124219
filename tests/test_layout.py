"""Lines out of cells against a sweep in plain Python."""

import random

from lakefolio.operators import layout


def plain_lines(cells):
    some = sorted(((y0 + y1) / 2, x0, " ".join(t.split()), x1, y0, y1, c) for t, x0, y0, x1, y1, c in cells if t and t.split())
    rows = []
    for cell in some:
        height = cell[5] - cell[4]
        if rows and abs(cell[0] - sum(c[0] for c in rows[-1]) / len(rows[-1])) <= max(2.5, height * 0.6):
            rows[-1].append(cell)
        else:
            rows.append([cell])
    out = []
    for n, row in enumerate(rows):
        row.sort(key=lambda c: (c[1], c[0], c[2]))
        parts = [[row[0]]]
        for a, b in zip(row, row[1:]):
            wide = b[1] - a[3] > max(layout.GAP, max(a[5] - a[4], b[5] - b[4], 1.0) * 2.2)
            parts.append([b]) if wide else parts[-1].append(b)
        for k, part in enumerate(parts):
            text, sure = " ".join(c[2] for c in part), sum(c[6] for c in part) / len(part)
            if sure >= layout.SURE or len(text) > layout.SHORT:
                out.append((n, k, text, min(c[1] for c in part), max(c[3] for c in part)))
    return out


def test_cells_in_any_order(spark):
    rng, rows = random.Random(8), []
    for page in range(40):
        for _ in range(rng.randint(1, 120)):
            x, y, h = rng.choice([0, 40, 80, 120, 300, 340]) + rng.random(), rng.randint(0, 12) * 14 + rng.uniform(-4, 4), rng.uniform(4, 14)
            rows.append((page if page else None, rng.choice(["Rechnung", "ee", "|", " a  b ", "", "Köln", None]), x, y, x + rng.uniform(5, 60), y + h, rng.choice([0.1, 0.9, None]), "z"))
    df = spark.createDataFrame(rows, "page int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, line string").repartition(4)
    got = layout.lines_of_cells(df, ["page"]).collect()
    for page in {r[0] for r in rows}:
        want = plain_lines([(t, x0, y0, x1, y1, 1.0 if c is None else c) for p, t, x0, y0, x1, y1, c, _ in rows if p == page])
        assert sorted((r.line, r.segment, r.text, r.x0, r.x1) for r in got if r.page == page) == want
    assert layout.lines_of_cells(df.limit(0), ["page"]).count() == 0
    gone = spark.createDataFrame([(1, "x", None, 1.0, 2.0, 2.0, 1.0), (2, "", 1.0, 1.0, 2.0, 2.0, 1.0), (3, "dust", 1.0, 1.0, 2.0, 2.0, 0.1)], "page int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert layout.lines_of_cells(gone, ["page"]).count() == 0


def test_running_heads(spark):
    rows = [(1, page, "Stadtwerke", 10.0) for page in range(3)] + [(1, 0, "Seite 1", 700.0), (1, 1, "Seite 2", 700.0), (2, 0, "Stadtwerke", 10.0), (1, 5, "Stadtwerke", 400.0)]
    df = spark.createDataFrame(rows, "doc int, page int, text string, y0 double")
    assert [tuple(r) for r in layout.repeated(df, "doc", "page").collect()] == [(1, "Stadtwerke", 1, 3)] or [r.pages for r in layout.repeated(df, "doc", "page").collect()] == [3]
