"""Components of links: few rounds and shuffles, and only labels go through them again when links are added."""

import random
import re

from labelforge.llm import jaccard_join
from tests.llm.data import empty


def brute(edges):
    """Least member of each set's component, of sets that aren't the least themselves."""
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {a: root(a) for a in up if root(a) != a}


def graph(rng, sets, links):
    return [(rng.randrange(-sets, sets), rng.randrange(-sets, sets)) for _ in range(links)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def labels_of(df):
    found = df.collect()
    got = {r.sid: r.label for r in found}
    assert len(got) == len(found)
    return got


def written(monkeypatch):
    names, keep = [], jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name: names.append((name, df)) or keep(df, name))
    return names


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    wheel = [(rng.choice([(i, 99), (99, i)])) for i in range(60)]  # a hub with lesser neighbours only
    for edges in (chain, wheel, [(5, 5)], [], graph(rng, 60, 50), graph(rng, 200, 180), chain + chain):
        assert labels_of(jaccard_join.components(frame(spark, edges))) == brute(edges)


def test_stars_take_one_round_of_four_shuffles(spark, monkeypatch):
    """Each round costs the driver a plan and a task for every partition of every shuffle."""
    names = written(monkeypatch)
    edges = [(10 * i, 10 * i + k) for i in range(5) for k in range(1, 10)]
    assert labels_of(jaccard_join.components(frame(spark, edges))) == brute(edges)
    assert [n for n, _ in names] == ["stars"]
    plan = names[0][1]._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert len(re.findall(r"\bExchange ", plan)) <= 4


def test_links_added_between_labels(spark):
    rng = random.Random(8)
    for links in (30, 90):
        first, more = graph(rng, 100, 60), graph(rng, 100, links)
        of = brute(first)
        between = [(of.get(a, a), of.get(b, b)) for a, b in more]
        got = jaccard_join.joined(jaccard_join.components(frame(spark, first)), frame(spark, between))
        assert labels_of(got) == brute(first + more)


def test_only_labels_go_through_the_rounds_again(spark, monkeypatch):
    """A long text in many versions: later checks add links, and the rounds then see no link within a component."""
    rng, seen, keep = random.Random(5), [], jaccard_join.components
    words, items = [f"w{i}" for i in range(160)], []
    for i in range(120):
        own = list(words)
        for k in rng.sample(range(160), 3):
            own[k] = f"x{i}y{k}"
        items.append((i, " ".join(own)))
    monkeypatch.setattr(jaccard_join, "components", lambda links: seen.append(sorted((r.a, r.b) for r in links.collect())) or keep(links))
    out = jaccard_join.link_components(spark.createDataFrame(items, "doc_id long, text string")).collect()
    assert len(out) == len(items) and len(seen) > 1
    of = brute(seen[0])
    for links in seen[1:]:
        assert not {x for pair in links for x in pair} & set(of)
        of = brute([*of.items(), *links])


def test_lists_without_tiles_of_two_sides_have_no_plan_for_them(spark):
    lists = spark.createDataFrame([(1, s, 100) for s in range(6)] + [(2, s, 100) for s in (1, 7)], "list_id long, sid long, n long")
    labels = spark.createDataFrame([(1, 0)], "sid long, label long")
    few, cut = (jaccard_join.open_tiles(lists, labels, tile) for tile in (6, 3))
    assert {(r.list_id, r.sid) for r in few.collect()} == {(r.list_id, r.sid) for r in cut.collect()} == {(r.list_id, r.sid) for r in lists.collect()}
    assert "Union" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert {r.side for r in few.collect()} == {0} and {r.side for r in cut.collect()} == {0, 1}


def test_nothing(spark):
    assert jaccard_join.link_components(empty(spark)).count() == 0
