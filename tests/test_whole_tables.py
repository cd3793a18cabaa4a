"""Queries over whole tables, against the rows of all of the table."""

import numpy as np

from quillspark.plans import registry, texts

SF = "/root/testdata/sf0.01"


def rows_of(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_serial_names(spark, monkeypatch):
    want, count = {}, {}
    for key, status in sorted(rows_of(spark, "orders", "o_orderkey", "o_orderstatus")):
        count[status] = count.get(status, 0) + 1
        want[key] = f"{status}_{count[status]:04d}.png"
    for stretch in (texts.KEY_STRETCH, 1000):
        monkeypatch.setattr(texts, "KEY_STRETCH", stretch)
        got = registry.QUERIES["serial_names"](spark, SF).collect()
        assert len(got) == len(want) > 10000 and {r.o_orderkey: r.name for r in got} == want


def test_box_mask_ratio(spark):
    masks = {}
    for order, line, part, supplier, quantity in rows_of(spark, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"):
        x, y = part % 90, supplier % 70
        x1, x2, y1, y2 = x - 2, int(x + quantity - 10) + 2, y - 2, y + line * 9 + 2
        mask = masks.setdefault(order, np.zeros((48, 64), bool))
        mask[max(0, min(y1, 48)) : max(0, min(y2, 48)), max(0, min(x1, 64)) : max(0, min(x2, 64))] = True
    got = {r.l_orderkey: r.mask_ratio for r in registry.QUERIES["box_mask_ratio"](spark, SF).collect()}
    assert got.keys() == masks.keys() and max(got) > 300
    assert all(abs(got[k] - round(float(m.mean()), 9)) < 1e-8 for k, m in masks.items())


def test_labels_of_whole_texts(spark):
    texts_of = dict(rows_of(spark, "documents", "doc_id", "text"))
    code = {d: "_".join(f"U{ord(c):04X}" for c in t) or "unknown" for d, t in texts_of.items()}
    assert {r.doc_id: r.code for r in registry.QUERIES["char_code_label"](spark, SF).collect()} == code
    for r in registry.QUERIES["file_label"](spark, SF).collect():
        bare = texts_of[r.doc_id].strip()
        assert r.label in (bare.rstrip(" ."), "_".join(f"U{ord(c):04X}" for c in bare))
