"""Times the headline queries: median of warm runs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from tidelens import catalogue
from tidelens.session import session

HEADLINE = [
    "time_filter", "range_filter", "line_filter_above", "bucket_mean", "tumbling_hour", "sliding_6h_2h30", "lttb_downsample", "profile_columns", "histogram_24",
    "column_stats", "pearson", "spearman_ties", "kde_64", "density_20x20", "rolling_bands_w50", "anomaly_zscore", "outlier_global_z", "fft_peaks", "ks_two_sample", "wasserstein", "psi", "lagged_corr",
    "corr_matrix", "drift_windows_daily", "window_quantiles", "spectrogram", "rolling_bands_by_type", "outlier_windowed_iqr", "pcmci_edges",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", f"local[{os.environ.get('BENCH_CPUS', '8')}]", spark__sql__shuffle__partitions="8", spark__driver__memory="20g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("OFF")
    found = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):
            begin = time.perf_counter()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        found[name] = round(median(times[1:]), 4)
    print(json.dumps({"metric": "headline queries, median of warm runs, summed", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf}))


if __name__ == "__main__":
    main()
