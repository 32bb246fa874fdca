"""A cross-section of registered queries against their SQL twins on the smallest tables."""

import os

import pytest

from check import compare, connect
from voltloom.catalog import CATALOG

SF = "/root/testdata/sf0.001"
SOME = ("prj_coerce_types", "win_rolling_stats", "rsk_guardian_report", "seg_segment_phases", "soh_field_gates",
        "sta_screen_cells", "soh_rul_error_table", "val_leave_group_out_cohorts", "val_cohort_coverage",
        "jn_signal_dictionary_join", "jn_cohort_envelope_join", "str_transition_stream")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    verdict, _, n = compare(spark, connect(SF), SF, name)
    assert verdict == "ok" and n > 0


def test_every_sql_has_a_query():
    assert set(CATALOG.sqls) <= set(CATALOG.builds)
    assert len(CATALOG.builds) > 120
