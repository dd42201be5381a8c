"""Line dedup by broadcast lines and by joined line numbers give the same rows, equal to plain Python."""

import hashlib

from piisieve.llm import lines

COLUMNS = "doc_id bigint, text string, source string, _kept string, _gone string, _c0 int, n_chars int"


def _docs(spark):
    rows = [(i, "\n".join([f"own {i}", "Shared LINE ", "", "é shared", "Shared LINE", f"pair {i // 2}"]), f"s{i % 12}") for i in range(24)]
    rows += [(3, "shared line\n" * 3, "s1"), (None, "é shared\nx", "s2"), (30, None, None), (31, "", "s3"), (32, "\n\n", "s4"),
             (33, "\n".join(["shared line", "alone"] * 20_000), "s5"), (33, "\n".join(["shared line", "alone"] * 20_000), "s5")]
    return spark.createDataFrame([(*r, "a", "b", 7, None if r[1] is None else len(r[1])) for r in rows], COLUMNS)


def _plain(rows):
    normal = lambda line: line.strip(" ").lower()
    sites, first = {}, {}
    for r in rows:
        for line in (r.text or "").split("\n") if r.text is not None else ():
            if line.strip():
                sites.setdefault(normal(line), set()).add(r.source or "")
                if r.doc_id is not None:
                    first[normal(line)] = min(first.get(normal(line), r.doc_id), r.doc_id)
    bad = {line for line, where in sites.items() if len(where) >= lines.MIN_SITES}
    out = []
    for r in rows:
        own = [] if r.text is None else r.text.split("\n")
        kept = [x for x in own if normal(x) not in bad or (r.doc_id is not None and first.get(normal(x)) == r.doc_id)]
        out.append((r.doc_id, None if r.text is None else "\n".join(kept), len(own) - len(kept)))
    return out


def _sorted(rows):
    return sorted(rows, key=repr)


def test_both_ways_equal_plain_python(spark):
    docs = _docs(spark)
    want = _plain(docs.collect())
    assert sum(n for *_, n in want) > 40_000
    for most in (lines.BROADCAST_LINES, 0):
        out = lines.deduplicated(docs, broadcast_lines=most)
        got = out.collect()
        assert out.columns == docs.columns and all(r._kept == "a" and r._gone == "b" and r._c0 == 7 for r in got)
        assert _sorted((r.doc_id, r.text) for r in got) == _sorted((d, t) for d, t, _ in want)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        rows = lines.report(docs, broadcast_lines=most).collect()
        assert _sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in rows) == _sorted(
            (d, n, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, n in want)


def test_lines_of_null_ids_go_everywhere(spark):
    docs = spark.createDataFrame([(None, f"shared line\nown {i}", f"s{i}") for i in range(12)], "doc_id bigint, text string, source string")
    for most in (lines.BROADCAST_LINES, 0):
        assert {r.text for r in lines.deduplicated(docs, broadcast_lines=most).collect()} == {f"own {i}" for i in range(12)}
