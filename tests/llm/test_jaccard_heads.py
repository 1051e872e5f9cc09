from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgerline.llm.jaccard_join import PLACES, _next_choices


def test_partners_of_what_leaves_a_bucket_are_linked_to_its_head():
    head, least = np.arange(PLACES, dtype=np.uint32), 36
    signatures, rows = [head], []
    for agree in range(PLACES):
        one = head.copy()
        one[agree:] += 1000
        partner = one.copy()  # agrees with the one at least places, and with the head at as few as can be
        partner[: PLACES - least] += 5000
        signatures += [one, partner]
    for rep, signature in enumerate(signatures):
        rows.append({"bucket": 1, "rep": rep, "signature": signature.tobytes(), "head": 0, "head_signature": head.tobytes()})
    schema = pa.schema([("bucket", pa.int64()), ("rep", pa.int64()), ("signature", pa.binary()), ("head", pa.int64()), ("head_signature", pa.binary())])
    linked, choosing = set(), set()
    for batch in _next_choices(iter([pa.RecordBatch.from_pylist(rows, schema)]), 0.8):
        for r in batch.to_pylist():
            (choosing if r["head"] is None else linked).add(r["rep"])
    gone = [agree for agree in range(PLACES) if 1 + 2 * agree not in choosing and (signatures[1 + 2 * agree] == head).sum() > PLACES * 0.8]
    assert gone and all({1 + 2 * agree, 2 + 2 * agree} <= linked for agree in gone)


def test_one_link_for_all_buckets_that_share_a_head():
    head = np.arange(PLACES, dtype=np.uint32)
    far = np.append(head[:40], head[40:] + 1000).astype(np.uint32)
    rows = [{"bucket": b, "rep": rep, "signature": s.tobytes(), "head": 0, "head_signature": head.tobytes()} for rep, s in ((1, head), (2, far)) for b in range(20)]
    schema = pa.schema([("bucket", pa.int64()), ("rep", pa.int64()), ("signature", pa.binary()), ("head", pa.int64()), ("head_signature", pa.binary())])
    found = [r for batch in _next_choices(iter([pa.RecordBatch.from_pylist(rows, schema)]), 0.8) for r in batch.to_pylist()]
    assert sorted((r["rep"], r["head"]) for r in found if r["head"] is not None) == [(1, 0), (2, 0)]
    chosen = [(r["rep"], r["bucket"]) for r in found if r["head"] is None]  # the far one chooses on from each bucket
    assert {rep for rep, _ in chosen} == {2} and len(set(chosen)) == len(chosen) > 20
