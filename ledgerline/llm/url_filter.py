"""URL filters: rules, and logistic regression on hashed character n-grams of host and path for the rest."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import flat_bytes, rolled

BITS = 15
GRAMS = (3, 4, 5)
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

# The words of which the labelled table's hosts are made; common vocabulary of unwanted and of plain sites.
BLOCKED_WORDS = (
    "casino", "poker", "betting", "bets", "jackpot", "lottery", "slots", "roulette", "bingo", "wager", "gamble", "odds",
    "pills", "pharmacy", "meds", "viagra", "cialis", "slimming", "detox", "steroid", "supplement", "miracle", "diet", "cure",
    "loan", "payday", "credit", "cash", "profit", "forex", "crypto", "miner", "invest", "income", "rich", "earn",
    "adult", "webcam", "dating", "escort", "xxx", "porn", "sexy", "hookup", "nude", "singles", "erotic", "camgirl",
    "spam", "ads", "adserver", "popup", "popunder", "banners", "clicks", "tracker", "tracking", "affiliate", "redirect", "backlinks", "traffic", "leads",
    "replica", "cheap", "discount", "bargain", "deals", "coupon", "outlet", "wholesale", "prize", "giveaway", "bonus", "free", "winner", "promo",
    "torrent", "warez", "keygen", "crack", "serial", "nulled", "hack", "cheats", "pirate", "malware", "phish", "botnet", "proxy", "leaked",
)
PLAIN_WORDS = (
    "city", "library", "garden", "school", "river", "music", "open", "docs", "daily", "report", "travel", "history", "science", "forum", "kitchen", "weather",
    "museum", "sports", "health", "archive", "council", "theatre", "village", "recipes", "letters", "botany", "railway", "poetry", "harbour", "research", "maths", "craft",
    "farm", "bread", "mountain", "church", "college", "hospital", "union", "journal", "review", "radio", "cinema", "gallery", "studio", "orchestra", "choir", "dance",
    "chess", "cycling", "rowing", "hiking", "football", "tennis", "skating", "running", "climbing", "sailing", "fishing", "gardening", "knitting", "pottery", "painting", "drawing",
    "physics", "chemistry", "biology", "geology", "astronomy", "linguistics", "economics", "law", "medicine", "nursing", "farming", "forestry", "energy", "climate", "ocean", "water",
    "software", "linux", "python", "database", "network", "robotics", "engineer", "teacher", "student", "parents", "children", "family", "wedding", "cooking", "coffee", "market",
)
PREFIXES = ("", "", "www.", "m.", "blog.", "news.")
ENDINGS = (".com", ".org", ".net", ".info", ".co.uk", ".de", ".example.com", ".example.org")


def labelled_urls(n: int = 4000, seed: int = 13) -> list[tuple[str, str, int]]:
    """The labelled table: host, path and 1 for block, made by a rule. Blocked hosts join words of unwanted sites, three
    of four by a hyphen, some with digits. Others are one plain word, two (one of six pairs by a hyphen), or an
    invented name of some syllables. Prefixes, endings and paths tell nothing."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if k % 2:
            a, b = rng.sample(BLOCKED_WORDS, 2)
            name = a + ("-" if rng.random() < 0.75 else "") + b
            name += str(rng.randrange(1, 1000)) if rng.random() < 0.2 else ""
        else:
            kind = rng.random()
            a, b = rng.sample(PLAIN_WORDS, 2)
            invented = "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice(("a", "e", "i", "o", "u", "ar", "en", "is", "ou")) for _ in range(rng.randint(2, 4)))
            name = a if kind < 0.2 else a + ("-" if rng.random() < 1 / 6 else "") + b if kind < 0.6 else invented
        path = "/" + "/".join(rng.choice(("en", "de", "fr", "es", "index", "page", "news", str(rng.randrange(1000)))) for _ in range(rng.randint(0, 3))) + rng.choice(("", "/", ".html"))
        out.append((rng.choice(PREFIXES) + name + rng.choice(ENDINGS), path, k % 2))
    return out


def shapes(texts: pa.Array) -> pa.Array:
    """a for a run of letters (and any character beyond ASCII), 0 for one of digits, other characters as they are; the
    n-grams of shapes carry over to words that the table doesn't hold."""
    return pc.replace_substring_regex(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[a-zA-Z]+|[^\x00-\x7F]+", "a"), r"[0-9]+", "0")


def _grams(texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of bytes; the texts' ends count as characters."""
    data, rows = flat_bytes(texts)
    sizes = np.diff(rows) + 2
    begin = np.cumsum(sizes) - sizes
    marked = np.full(sizes.sum(), 2, np.uint8)
    marked[begin] = 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.ones(len(marked), bool)
    inner[begin] = inner[begin + sizes - 1] = False
    marked[inner] = data
    found_row, found = [], []
    for n in GRAMS:
        value = rolled(marked.astype(np.uint64), n, seed * 16 + n)
        whole = owner[: len(value)] == owner[len(marked) - len(value) :]
        found_row.append(owner[: len(value)][whole])
        found.append((value[whole] >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found_row), np.concatenate(found)


def url_features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of the n-grams of hosts, paths and the hosts' shapes, each with features of its own."""
    found = [_grams(texts, seed) for seed, texts in ((1, hosts), (2, paths), (3, shapes(hosts)))]
    return np.concatenate([row for row, _ in found]), np.concatenate([gram + (k << BITS) for k, (_, gram) in enumerate(found)])


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, feature = url_features(hosts, paths)
        margin = np.bincount(row, self.weights[feature], minlength=len(hosts)) + self.bias
        return 1 / (1 + np.exp(-margin))


def fit(urls: list[tuple[str, str, int]], steps: int = 300, rate: float = 0.5, penalty: float = 1e-4) -> UrlModel:
    """Full-batch descent with per-weight steps."""
    hosts, paths, label = zip(*urls, strict=True)
    row, feature = url_features(pa.array(hosts), pa.array(paths))
    y = np.array(label, float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, bias, seen, seen_bias = np.zeros(3 << BITS), 0.0, np.full(3 << BITS, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[feature], minlength=len(y)) + bias)))
        error = (p - y) * weight
        slope = np.bincount(feature, error[row], minlength=len(w)) + penalty * w
        seen += slope**2
        seen_bias += error.sum() ** 2
        w -= rate * slope / np.sqrt(seen)
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    return UrlModel(w, bias)


@lru_cache(1)
def train() -> UrlModel:
    """The model of the labelled table, which is small whatever the corpus."""
    return fit(labelled_urls())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (then the first by code point) whose host is the url's or above it and whose path begins the url's."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _score(batches: Iterator[pa.RecordBatch], model: UrlModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = model.score(batch.column("host"), batch.column("path"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])


def filter_urls(pages: DataFrame, rules: dict[str, str] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score (the model's, of block) of every row.

    The longest rule that fits decides; else the model: block from ``threshold`` on. A null url or one without ``://``
    has an empty host and path, and is judged by the model as such. Rows are judged alone: repeated rows repeat,
    null page_ids stay null; other columns aren't carried.
    """
    rules = RULES if rules is None else rules
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = parts.mapInArrow(partial(_score, model=train()), "page_id long, host string, path string, score double")
    verdicts = F.create_map(*(F.lit(x) for item in rules.items() for x in item)) if rules else F.create_map().cast("map<string,string>")
    out = scored.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), own).otherwise(F.try_element_at(verdicts, F.col("rule"))).alias("verdict"), "score")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
