"""The registered health scores against a cycle count by plain Python."""

from lodestone.operators import analytics
from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"


def back_edges(pairs):
    """Edges of a depth-first search that lead to a node on its way; each closes a cycle of its own."""
    after = {}
    for s, t in sorted(pairs):
        after.setdefault(s, []).append(t)
    done, found = set(), 0
    for root in sorted(after):
        way, on = [(root, iter(after[root]))], {root}
        while way and root not in done:
            to = next(way[-1][1], None)
            if to is None:
                node = way.pop()[0]
                on.discard(node)
                done.add(node)
            elif to in on:
                found += 1
            elif to not in done:
                on.add(to)
                way.append((to, iter(after.get(to, ()))))
    return found


def test_health_counts_cycles(spark):
    g = catalog.graph(spark, SF)
    edges = g.edges.filter("kind IN ('calls', 'imports')").select("source_id", "target_id").collect()
    cycles = back_edges({(e.source_id, e.target_id) for e in edges})
    assert cycles > 0
    without, got = analytics.health(g).first(), catalog.queries()["dna_health"](spark, SF).first()
    assert got.modularity == max(0, 100 - 10 * cycles)
    parts = (got.modularity, got.dead, got.coverage, got.complexity)
    assert parts[1:] == (without.dead, without.coverage, without.complexity)
    assert got.overall == int(sum(parts) / 4 + 0.5)
