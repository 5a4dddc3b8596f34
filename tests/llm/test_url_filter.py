"""URL verdicts: rules against a plain reading of them, the model on hosts that it hasn't seen."""

import re

import pyarrow as pa
import pytest

from indexloom.llm import queries, url_filter

URLS = [
    None, "", "no scheme/en/", "http://", "https://EXAMPLE.com", "https://example.com/en/1", "https://example.com/en", "http://www.Example.com/en/x?q#f", "ftp://a.www.example.com/en/", "https://notexample.com/en/2",
    "https://shop.net/es/1", "https://net/fr/", "https://x.net/FR/", "https://x.org/es/#top", "https://x.com?next=http://y.net/es/", "://z.net/es/p", "a://b://c.net/es/", "https://x.net\n/es/", "https://été.example.org/ça/là", "https://x.net/" + "long/" * 50_000,
]


def plain(url):
    """Host, path, rule and its verdict by the contract's words."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, u, "clash", "clash", 0) for k, u in enumerate(URLS + URLS[3:6])], "page_id long, url string, host string, verdict string, score int")


def test_hosts_paths_and_rules(pages):
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(URLS) + 3
    for k, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert [got[k].verdict for k in (0, 1, 2, 3)] == ["allow"] * 4 and got[19].verdict == "allow"
    assert [(got[len(URLS) + i].verdict, got[len(URLS) + i].score) for i in range(3)] == [(got[3 + i].verdict, got[3 + i].score) for i in range(3)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op11_url_filter(spark, sf).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    assert len(rows) == len(urls)
    assert all((r.host, r.path, r.rule) == plain(urls[r.page_id])[:3] for r in rows)
    learned = {u.split("://")[1].split("/")[0] for u, _ in url_filter.labelled_urls()}
    assert not learned & {r.host for r in rows}
    for r in rows:
        if r.rule is None:
            assert (r.verdict == "block") == bool(re.search("casino|bets|pills|spam|ads-|adult", r.host)), r


def test_scores_equal_those_worked_out_one_by_one():
    model = url_filter.train(["ab.cd", "xxabc.net", "q"], ["/", "", "/zz/1"], [0, 1, 0])
    hosts, paths = ["ab.cd", "", "xxabc.net", "q", "nothing known"], ["/", "", "", "/zz/1", "/long" * 500]
    together = model.scores(pa.array(hosts, pa.large_string()), pa.array(paths, pa.large_string()))
    alone = [model.scores(pa.array([h], pa.large_string()), pa.array([p], pa.large_string()))[0] for h, p in zip(hosts, paths, strict=True)]
    assert together.tolist() == pytest.approx(alone)
    assert together[1] == pytest.approx(url_filter.PRIOR) and together[2] > 0.5 > together[0]


def test_newton_finds_the_minimum():
    """The gradient of the weighted loss with its ridge vanishes at the fitted weights."""
    import numpy as np

    urls = url_filter.labelled_urls()[::9]
    hosts, paths = zip(*(plain(u)[:2] for u, _ in urls), strict=True)
    y = np.array([v for _, v in urls], float)
    model = url_filter.train(list(hosts), list(paths), y.astype(int).tolist())
    row, bucket, value = url_filter.features(pa.array(hosts, pa.large_string()), pa.array(paths, pa.large_string()))
    p = model.scores(pa.array(hosts, pa.large_string()), pa.array(paths, pa.large_string()))
    pull = (0.5 / np.where(y == 1, y.mean(), 1 - y.mean()) * (p - y))[row] * value
    gradient = np.bincount(bucket, weights=pull, minlength=url_filter.BUCKETS) + url_filter.RIDGE * model.weights
    assert np.abs(gradient).max() < 1e-3


def test_own_labels_and_bounds(spark, pages):
    labelled = spark.createDataFrame([("https://aaa.org/", 0), ("https://bbb.org/", 1), (None, 1), ("https://ccc.org/", None)], "url string, unwanted int")
    got = url_filter.judge(spark.createDataFrame([(1, "https://bbb.org/"), (2, "https://aaa.org/")], "page_id long, url string"), labelled).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "allow"]
    assert url_filter.judge(pages, labelled.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    with pytest.raises(ValueError):
        url_filter.model_of(spark.range(url_filter.MAX_LABELLED + 1).selectExpr("cast(id as string) url", "1 unwanted"))
    assert url_filter.judge(pages.limit(0)).count() == 0
