"""Sinks for traces and privacy curves."""


def write_trace(df, path):
    """Append metric rows, one folder per run, so a run's history is one partition."""
    df.write.partitionBy("run_id").mode("append").parquet(path)
    return path


def write_eps_curve(df, path):
    """Two columns of text: noise scale and the epsilon it buys."""
    df.select("sigma", "eps").write.mode("overwrite").csv(path)
    return path


def run_label(params, prefix=""):
    """Name of a run: two letters of each parameter and its value in short form."""
    return prefix + "_".join(f"{name[:2]}{value:g}" for name, value in params.items())
