from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa

from ledgerline.llm import url_filter as uf
from ledgerline.llm.arrays import multipliers

MASK = (1 << 64) - 1


def plain_score(model, host, path):
    """The logistic model's score in plain Python: every n-gram of host, path and host shape, ends marked."""
    shape = re.sub(r"[0-9]+", "0", re.sub(r"[a-zA-Z]+|[^\x00-\x7f]+", "a", host))
    total = model.bias
    for k, text in enumerate((host, path, shape)):
        data = b"\x01" + text.encode() + b"\x02"
        for n in uf.GRAMS:
            factors = [int(c) for c in multipliers(n, (k + 1) * 16 + n)]
            for i in range(len(data) - n + 1):
                x = sum(b * c for b, c in zip(data[i : i + n], factors, strict=True)) & MASK
                x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
                x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
                x ^= x >> 31
                total += model.weights[(x >> (64 - uf.BITS)) + (k << uf.BITS)]
    return 1 / (1 + math.exp(-total))


def plain_parts(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [r for r in uf.RULES if (lambda own, start: (host == own or host.endswith("." + own)) and path.startswith("/" + start))(*r.split("/", 1))]
    return max(fits, key=len, default=None)


def test_whole_table_by_brute_force(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    found, model = uf.op8_url_filter(spark, sf_dir).collect(), uf.train()
    assert len(found) == len(urls)
    for r in found:
        host, path = plain_parts(urls[r.page_id])
        rule, score = plain_rule(host, path), plain_score(model, host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and abs(r.score - score) < 1e-9
        assert r.verdict == (uf.RULES[rule] if rule else "block" if score >= 0.5 else "allow")


def test_hosts_of_unseen_words():
    """Four folds over the words: hosts both of whose words the fit never saw. Measured: 0.85, 0.81, 0.81 and 0.77."""
    urls, words = uf.labelled_urls(), uf.BLOCKED_WORDS + uf.PLAIN_WORDS
    inside = lambda host: {w for w in words if w in re.sub(r"^(www|m|blog|news)\.", "", host).split(".")[0]}
    right = []
    for fold in range(4):
        unseen = set(uf.BLOCKED_WORDS[fold::4]) | set(uf.PLAIN_WORDS[fold::4])
        model = uf.fit([u for u in urls if not inside(u[0]) & unseen])
        hosts, paths, labels = zip(*(u for u in urls if inside(u[0]) and inside(u[0]) <= unseen), strict=True)
        right.append(np.mean((model.score(pa.array(hosts), pa.array(paths)) >= 0.5) == np.array(labels, bool)))
    assert min(right) > 0.65 and np.mean(right) > 0.72
