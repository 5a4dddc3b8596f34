"""URL filters: rules by host and path first, then a logistic regression on hashed character n-grams.

A url's host and path become counts of the hashes of their n-grams, host and path apart and each
divided by the root of its number, so that a long path says no more than a short one. The model is
fitted on the driver from a small labelled table of urls (MAX_LABELLED rows, more are an error): by
Newton's steps in the space of the rows, of which there are few, with all their n-grams. Its weights,
one float for each of BUCKETS hashes (a megabyte), go out with the tasks; nothing is shuffled.

The labelled table that comes with it is made by rule from lists of words that adult, gambling,
pharmacy, advertising and spam hosts carry, and of words that ordinary hosts carry; no url of the
judged tables is in it. Another one can be given.

A null url, or one without ``://``, has an empty host and path: no rule fits, no n-gram speaks, and
PRIOR decides, for allowing it; so it does where no labels, or only one of the two, are given. Of rules that fit, the one with the longest text of host and path wins;
equal ones can't both fit. Empty and very long urls are taken whole; n-grams are of UTF-8 bytes.
Repeated rows give repeated results. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.llm import textops

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
RIDGE = 0.02
PRIOR = 0.2  # how likely a url is unwanted of whose n-grams none is known
MAX_LABELLED = 5000
THRESHOLD = 0.3  # above what an unknown name has
CONSTANT = float(np.log(PRIOR / (1 - PRIOR)))

#: (verdict, host, path): the rule fits the host and its subdomains where the path starts so. Fixed values.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Words that make up the labelled urls.
UNWANTED = ("casino", "poker", "bets", "betting", "slots", "jackpot", "gamble", "adult", "porn", "xxx", "sex", "escort", "nude", "pills", "pharma", "viagra", "replica", "spam", "ads", "adserver", "track", "tracker", "clicks", "popup", "malware", "phish", "warez", "crack", "torrent", "payday")
BESIDE = ("best", "hot", "live", "online", "club", "top", "my", "go24", "vip", "zone")
ORDINARY = ("news", "library", "museum", "garden", "weather", "school", "journal", "recipes", "history", "science", "music", "travel", "forum", "docs", "wiki", "city", "river", "mountain", "energy", "health", "kitchen", "books", "theatre", "market", "adventure", "tradition", "essex", "address", "trackside", "pillow")
SYLLABLES = ("th", "er", "in", "on", "re", "an", "st", "ing", "ble", "ou", "ti", "ha", "ly", "nd", "wh", "en", "sh", "tion", "es", "or")
SUBDOMAINS, ENDINGS = ("", "www.", "m.", "blog."), ("example.com", "example.org", "example.net")
PATHS = ("/", "/en/1001", "/de/204.html", "/fr/77/", "/es/3305", "/about", "/2021/05/post-17.html", "/a/b/c?d=e")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 if it is unwanted): unwanted words with others beside them, ordinary words alone, in pairs, and invented names."""
    invented = [a + b for a, b in product(SYLLABLES, repeat=2)]

    def beside(words: tuple[str, ...]) -> list[str]:
        """Each word alone, and before and behind words of both kinds that say nothing."""
        out = list(words)
        for i, w in enumerate(words):
            for k in range(10):
                n = i * 10 + k
                other = invented[n * 37 % len(invented)] if k % 2 else BESIDE[n // 2 % len(BESIDE)]
                out.append(("-" if n % 3 else "").join((w, other) if k % 4 < 2 else (other, w)))
        return out

    bad, good = beside(UNWANTED) * 2, beside(ORDINARY) + invented[::2] + [a + b + c for a, b, c in product(SYLLABLES, repeat=3)][::31] + [f"{a}-{b}" for a, b in zip(invented[1::4], invented[3::4], strict=True)]
    out, dice = [], random.Random(11)  # paths, endings and subdomains say nothing about the label
    for names, unwanted in ((bad, 1), (good, 0)):
        out += [(f"https://{dice.choice(SUBDOMAINS)}{name}.{dice.choice(ENDINGS)}{dice.choice(PATHS)}", unwanted) for name in names]
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path of a url; both empty without one."""
    behind = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    part = lambda k: F.coalesce(F.regexp_extract(behind, r"(?s)^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The fitting rule with the longest text, and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones lie outside, so the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _grams(texts: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of every n-gram of the texts; a text's ends are marked."""
    buf, offsets = textops.utf8(texts)
    n = len(offsets) - 1
    at = offsets + 2 * np.arange(n + 1)  # a mark before and one behind each text
    long = np.zeros(at[-1], dtype=np.uint64)
    filled = np.ones(at[-1], dtype=bool)
    filled[at[:-1]] = filled[at[1:] - 1] = False
    long[filled] = buf
    row = np.repeat(np.arange(n), np.diff(at))
    hashes, h = [], np.zeros(len(long), dtype=np.uint64)
    for k in range(max(GRAMS)):
        if k >= len(long):
            break
        h = (h[: len(long) - k] * np.uint64(0x100000001B3)) ^ (long[k:] + np.uint64(salt))
        if k + 1 in GRAMS:
            whole = row[: len(h)] == row[k:]
            hashes.append((row[: len(h)][whole], textops.mix(h[whole] + np.uint64(k)) % np.uint64(BUCKETS)))
    rows = np.concatenate([x for x, _ in hashes]) if hashes else np.zeros(0, np.int64)
    buckets = np.concatenate([x for _, x in hashes]).astype(np.int64) if hashes else np.zeros(0, np.int64)
    return rows, buckets, 1.0 / np.sqrt(np.bincount(rows, minlength=n)[rows])


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(_grams(hosts, 1), _grams(paths, 512), strict=True))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """How likely each url is unwanted."""
        row, bucket, value = features(hosts, paths)
        z = np.bincount(row, weights=self.weights[bucket] * value, minlength=len(hosts)) + CONSTANT
        return 1 / (1 + np.exp(-z))


def train(hosts: list[str], paths: list[str], labels: list[int]) -> Model:
    """Ridge logistic regression: Newton's steps on the coefficients of the rows, to which the weights are linear."""
    n = len(labels)
    if not n or len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32))
    row, bucket, value = features(pa.array(hosts, pa.large_string()), pa.array(paths, pa.large_string()))
    used, place = np.unique(bucket, return_inverse=True)
    x = np.zeros((n, len(used)), dtype=np.float32)
    np.add.at(x, (row, place), value)
    y = np.array(labels, dtype=float)
    share = np.array([1 - y.mean(), y.mean()])
    weight = 0.5 / share[y.astype(int)]  # both labels weigh the same
    kernel = (x @ x.T).astype(float)
    alpha = np.zeros(n)
    for _ in range(50):
        z = kernel @ alpha + CONSTANT
        p = 1 / (1 + np.exp(-z))
        w = np.maximum(weight * p * (1 - p), 1e-9)
        new = np.linalg.solve(kernel + np.diag(RIDGE / w), z - CONSTANT + weight * (y - p) / w)
        moved, alpha = np.abs(new - alpha).max(), new
        if moved < 1e-9:
            break
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = x.T @ alpha
    return Model(weights)


def model_of(labelled: DataFrame) -> Model:
    """The model of a table (url, unwanted) of at most MAX_LABELLED rows; rows without a label are left out."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("unwanted is not null").select(host.alias("h"), path.alias("p"), F.col("unwanted").cast("int").alias("y")).limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    rows.sort()
    return train([r.h for r in rows], [r.p for r in rows], [r.y for r in rows])


_RESULT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row of pages (page_id, url)."""
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(labelled_urls(), "url string, unwanted int")
    model = model_of(labelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "path"):
                hosts, paths = textops.text_column(part, "host"), textops.text_column(part, "path")
                scores = model.scores(hosts, paths)
                given = part.column(4).to_pylist()
                verdict = [v or ("block" if s >= THRESHOLD else "allow") for v, s in zip(given, scores, strict=True)]
                yield textops.batch_of(_RESULT, part.column(0).cast(pa.int64()), hosts.cast(pa.string()), paths.cast(pa.string()), part.column(3).cast(pa.string()), verdict, np.round(scores, 6))

    host, path = host_and_path(F.col("url"))
    split = textops.narrow(pages, "page_id", host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    return split.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict")).mapInArrow(score, "page_id long, host string, path string, rule string, verdict string, score double")
