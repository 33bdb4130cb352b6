"""Each registered query of the grid engine against its SQL, on the smallest tables: a fixed choice of them, or all if ALL_ORACLES is set (some ten minutes)."""

import os

import duckdb
import pytest

from lacuna.plans import registry

CHOSEN = ["f4_sum_absolute", "f15_angle", "a1_patch_ssd", "a5_vectorised_difference", "a6_vectorised_indices_difference", "a7_gmh_difference", "a10_under_the_hole", "io6_image_sink", "io7_final_image", "io10_iterations", "io11_debug_regions", "io13_target_patch", "k5_knn_stride", "k10_limit_local_reuse", "k13_below_threshold_or_all", "k13_fall_back_to_all", "k14_two_step", "k18_local_optimisation", "k24_insert_erase", "k24_metric_knn_by_label", "k24_metric_range", "k25_vantage_point", "k26_best_in_each_graph", "p5_neighborhood_search", "p10_stride", "p18_vectorised_patch", "p19_feature_vector_of_patch", "p20_precomputed_features", "p24_region_copy", "w1_masked_derivative", "w3_masked_sobel", "w9_boundary_energy", "w13_masked_blur", "w15_across_hole", "q3_confidence_update", "q7_curvature", "q12_push_or_update", "q16_sort_by_score", "q13_top", "u1_paint_patch", "u2_paint_vertex", "u3_paint_two_images", "u7_replay", "g7_forward_look", "k3_knn_join", "k7_best_no_check", "k8_knn_of_all_targets", "k20_best_and_write", "k9_limit_reuse_of_log", "k10_limit_local_reuse_of_log", "k11_no_reuse_of_log", "u7_replay_log", "u5_finish_vertex_effects", "q4_criminisi", "q5_criminisi_update", "q6_improved_criminisi", "q10_random", "w5_masked_gradient", "w7_isophotes", "w12_introduced_energy", "r1_histogram_difference_of_all", "r7_quadrant_histogram_of_all", "r12_color_texture_of_all", "r9_strategy_selection", "r10_introduced_energy_choice", "r16_lidar_texture_sorted", "r17_lidar_derivatives", "p20_normals", "v28_colour_clusters", "io1_mha_round_trip", "io5_structured_grid", "g7_forward_look_outside", "r13_sort_by_gmh", "r8_adaptive_dual_quadrant_histogram", "v5_average_difference", "v12_dilated_source_hole_target_valid", "v20_all_quadrants"]
NAMES = sorted(registry.ORACLES) if os.environ.get("ALL_ORACLES") else CHOSEN
SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    cur = c.execute(f"SELECT * FROM ({registry.ORACLES[name]}) LIMIT 10000000")  # a row limit has kept some joins waiting
    cols = [d[0] for d in cur.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr([plain(r[k]) for k in cols]) for r in df.collect()) == sorted(repr([plain(x) for x in r]) for r in cur.fetchall())
