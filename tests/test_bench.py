import bench
from stratacloud import catalog


def test_headline_assigns_routes_and_thins():
    assert {"chunk_routing", "leaf_assign", "lod_nodes", "hierarchy_offsets", "temporal_pages", "return_histogram"} <= set(bench.HEADLINE) <= set(catalog.queries())
