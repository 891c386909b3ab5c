"""Parts of bounded size, plain ways through the parser and the text patterns."""

import pyarrow as pa

from pagelift.functions import text as tx
from pagelift.functions.batches import parts_of
from pagelift.operators.nodes import parse_html


def test_parts_hold_few_bytes_and_all_rows():
    texts = ["x" * 100, None, "y" * 5000, "", "é" * 300, None] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "t"])
    parts = list(parts_of(batch, "t", 6000))
    assert [t for p in parts for t in p.column("t").to_pylist()] == texts
    assert len(parts) > 40 and all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("t").to_pylist()) <= 6000 for p in parts)


def test_only_list_items_get_a_digest():
    nodes, _ = parse_html('<div id="a&amp;b" class="c"><p>x</p><ul><li class="q  r">1</li><li class="q r">1</li></ul></div>')
    assert nodes[0].attrs == {"id": "a&b", "class": "c"}
    first, second = (n for n in nodes if n.tag == "li")
    assert first.sig == second.sig and all(n.sig is None for n in nodes if n.tag in ("div", "p", "ul"))


def test_white_space_as_python_has_it(spark):
    rows = [f"{a}b{c}d{a}" for a in map(chr, [*range(0x21), 0x85, 0xa0, 0x1680, 0x180e, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000, 0xfeff])
            for c in (" ", "  ", a, "\r\n", " \n ", "\r")]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    found = df.select("t", tx.py_strip("t").alias("s"), tx.collapse_ws("t").alias("c"), tx.words("t").alias("w"), tx.lines("t").alias("l")).collect()
    for r in found:
        assert (r.s, r.c, r.w) == (r.t.strip(), " ".join(r.t.split()), r.t.split())
        assert [x for x in r.l if x] == [x for x in r.t.splitlines() if x]
    assert "regexp" not in str(df.select(tx.py_strip("t"))._jdf.queryExecution().optimizedPlan()).lower()
