import os

import pytest

from factloom.plans import registry

from .oracle import differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: Without SQL, as it is too slow for them: `test_whole_graphs` holds these against brute force.
UNCHECKED = {"component_sizes_topn_whole", "label_propagation", "weak_components_whole"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    frame = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in UNCHECKED and frame.count() > 0
    else:
        assert differences(frame, sql, SF) is None
