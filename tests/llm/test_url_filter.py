import math

import pyarrow as pa

from tallyforge.llm.url_filter import BUCKETS, RULES, SIZES, judge, split, train
from tallyforge.llm.url_table import UNWANTED, WANTED, urls


def slow_rule(host, path):
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best or (None, None)


#: Topics that show the model which parts of a URL tell nothing; they are in every fold.
PLAIN = ("places", "plain")
#: Ordinary URLs that the table has not.
ORDINARY = """https://www.walmart.com/ip/123 https://www.cnn.com/2021/ https://www.target.com/c/toys https://www.dropbox.com/home https://www.mozilla.org/en-US/firefox/ https://www.apple.com/mac/
https://www.paypal.com/us/home https://www.netflix.com/title/1 https://www.reddit.com/r/science https://news.ycombinator.com/item https://www.yelp.com/biz/cafe https://www.airbnb.com/rooms/1 https://www.zalando.de/herren
https://www.tagesschau.de/inland https://www.abc.es/espana https://www.ouest-france.fr/bretagne https://www.cam.ac.uk/research https://www.princeton.edu/academics https://www.nist.gov/topics https://www.unicef.org/child
https://www.gnu.org/licenses/ https://www.archlinux.org/packages/ https://www.java.com/en/download https://www.r-project.org/about.html https://www.timeanddate.com/worldclock https://www.nationalgeographic.com/animals
https://www.ted.com/talks https://www.deezer.com/fr https://www.transfermarkt.de/statistik https://www.leboncoin.fr/recherche https://www.free.fr/freebox""".split()


def scores(model, found):
    host, path = zip(*map(split, found))
    return model.score(pa.array(host), pa.array(path))


def slow_score(model, url):
    """The model's score of one URL, n-gram by n-gram in plain Python."""
    z = model.bias
    for tag, part in zip((1, 2), split(url)):
        b = b"^" + part.encode() + b"$"
        w = []
        for n in SIZES:
            for i in range(len(b) - n + 1):
                h = tag * 16 + n
                for x in b[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + x + 1) % 2**64
                h ^= h >> 30
                h = h * 0xBF58476D1CE4E5B9 % 2**64
                h ^= h >> 27
                h = h * 0x94D049BB133111EB % 2**64
                h ^= h >> 31
                w.append(model.weights[h % BUCKETS])
        z += sum(w) / math.sqrt(len(w)) if w else 0
    return 1 / (1 + math.exp(-z))


def test_held_out_topics():
    """Whole topics, with their hosts and words, are held out."""
    bad, good = ([t for t in x if t not in PLAIN] for x in (UNWANTED, WANTED))
    hit = missed = wrong = 0
    for k in range(5):
        out = {*bad[k::5], *good[k::5]}
        m = train(urls(UNWANTED, [t for t in UNWANTED if t not in out]), urls(WANTED, [t for t in WANTED if t not in out]))
        found = scores(m, urls(UNWANTED, bad[k::5])) >= 0.5
        hit, missed = hit + found.sum(), missed + (~found).sum()
        wrong += (scores(m, urls(WANTED, good[k::5])) >= 0.5).sum()
    print("held-out topics: precision", hit / (hit + wrong), "recall", hit / (hit + missed))
    assert hit / (hit + wrong) >= 0.9 and hit / (hit + missed) >= 0.85


def test_ordinary_urls_pass():
    m = train(urls(UNWANTED), urls(WANTED))
    assert (scores(m, ORDINARY) >= 0.5).sum() <= 1
    assert scores(m, ["http://\u4e2d\u6587/"])[0] < 0.5


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en", "http://x.com", "http://x.com?q=/en/", "ftp://net/es/1", "http://b.NET/fr/2#/x", "x://y://z/k", "http://www.example.com/en/", "http://É.com/\n/a", "http://notexample.com/en/1"]


def test_rules(spark):
    got = judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(ODD)], "page_id long, url string, host string")).collect()
    for r in got:
        host, path = split(ODD[r.page_id] or "")
        verdict, rule = slow_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert len(got) == len(ODD)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in judge(pages).collect()}
    assert len(got) == pages.count()
    model = train(urls(UNWANTED), urls(WANTED))
    blocked = {True: [], False: []}
    table = {split(u)[0] for x in (UNWANTED, WANTED) for u in urls(x)}
    for r in pages.collect():
        host, path = split(r.url or "")
        verdict, rule = slow_rule(host, path)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert abs(g.score - slow_score(model, r.url or "")) < 1e-9
        assert g.verdict == (verdict if rule else "block" if g.score >= 0.5 else "allow")
        assert host not in table
        blocked[any(x in host for x in ("spam", "pills", "casino", "bets", "adult", "ads"))].append(g.score >= 0.5)
    assert sum(blocked[True]) >= 0.95 * len(blocked[True]) and sum(blocked[False]) <= 0.05 * len(blocked[False])
    assert judge(pages.limit(0)).count() == 0
    two = spark.createDataFrame([(None, "http://q.org/1"), (None, "http://q.org/1")], "page_id long, url string")
    assert judge(two).count() == 2
