import os

import pytest

from graphloom.plans import registry
from graphloom.sources.domain import load

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_every_method_is_available_in_its_owner(spark):
    own = {(r.owner, r.name) for r in registry.queries()["method_availability"](spark, SF).where("available_in = owner").collect()}
    assert own == {(r.owner, r.name) for r in load(spark, SF, "methods").select("owner", "name").distinct().collect()}
