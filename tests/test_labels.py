"""Labels by the documented words, units, small words, numbers and residual suffixes."""

from terracause.functions import columns as C


def said(spark, make, *names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, v string")
    return [r.x for r in df.select("i", make.alias("x")).orderBy("i").collect()]


def test_display_labels(spark):
    names = ["boot_prob_gt_zero", "of-mice_and_MEN", "ndvi_2.5_m", "  temp__max ", "", "corr-by_lag 3", "sd", "x" * 1500, None, "école_à"]
    want = ["Bootstrap Probability Greater Than Zero", "Of Mice and Men", "NDVI 2.5 m", "Temp Max", "", "Correlation by Lag 3", "SD", "X" + "x" * 1499, None, "École À"]
    assert said(spark, C.display_label("v"), *names) == want


def test_variable_labels(spark):
    names = ["temperature_resid", "ndvi_resid", "soil_moisture_7_to_28_cm_resid", "custom_driver", "custom_DRIVER_residual", "month_sin", None]
    want = ["2 m air temperature anomaly", "NDVI anomaly", "Soil moisture (7–28 cm) anomaly", "Custom driver", "Custom driver anomaly", "Month (sine)", None]
    assert said(spark, C.variable_label("v"), *names) == want
    assert said(spark, C.variable_label("v", {"temperature_resid": "Air-temperature anomaly"}), "temperature_resid", "temperature") == ["Air-temperature anomaly", "2 m air temperature"]
    assert said(spark, C.variable_label("v", {"temperature": "Near-surface air temperature"}), "temperature_resid") == ["Near-surface air temperature anomaly"]
