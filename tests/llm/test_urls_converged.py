import numpy as np

from proofweave.llm import queries, urls


def anchors(*hosts):
    return "".join(f'<a href="https://{h}/">t</a>' for h in hosts)


def linked():
    """A farm that links to 100 blocked hosts, a chain of 12 hosts to it, and a cycle with one way out to it."""
    links = {"farm.biz": [f"bad{k}.net" for k in range(100)], "c1.biz": ["farm.biz"]} | {f"c{k}.biz": [f"c{k - 1}.biz"] for k in range(2, 13)}
    return links | {"y0.biz": ["y1.biz", "c9.biz"], "y1.biz": ["y2.biz"], "y2.biz": ["y0.biz"]}


def solved(links, seeds):
    hosts = sorted(set(links) | {t for ts in links.values() for t in ts})
    at, moves = {h: k for k, h in enumerate(hosts)}, np.zeros((len(hosts), len(hosts)))
    for h, targets in links.items():
        for t in targets:
            moves[at[h], at[t]] += 1  # against the link
    moves /= np.maximum(1, moves.sum(0))
    rank = np.linalg.solve(np.eye(len(hosts)) - urls.DAMPING * moves, [seeds.get(h, 0.0) for h in hosts])
    return dict(zip(hosts, rank.tolist(), strict=True))


def test_chain_and_cycle_against_the_solved_system(spark):
    links = linked()
    seeds = {f"bad{k}.net": 1.0 for k in range(100)}
    want = solved(links, seeds)
    edges = spark.createDataFrame([(h, t, 1) for h, ts in links.items() for t in ts], "source string, target string, links long")
    got = dict(urls.propagated(spark.createDataFrame(list(seeds.items()), "host string, seed double"), edges, "target", "source").collect())
    assert set(got) == {h for h, r in want.items() if r} and all(abs(got[h] - want[h]) <= urls.TOLERANCE for h in got)
    rows = [(k, f"http://{h}/", anchors(*ts)) for k, (h, ts) in enumerate(links.items())] + [(1000 + k, f"http://{h}/", "") for k, h in enumerate(seeds)]
    said = {r.host: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert said == {h: "block" if want[h] >= urls.THRESHOLD else "allow" for h in said}
    assert said["c12.biz"] == said["y1.biz"] == "block"
