"""The registered queries. Doubles are rounded to eight decimals (values are of order one), because engines add in
different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import bases
from panelforge.functions import matrix as mx
from panelforge.operators import evaluate, figures, forecast, fourier, inference, invariants, ordering, panel, reference, residual, timeseries
from panelforge.operators import matrices as mt
from panelforge.operators.panel import with_lags
from panelforge.plans.design import BLOCK_SIZE, Design, lineitem_design
from panelforge.sources import validate
from panelforge.sources.panels import carried_forward, event_buckets, lineitem_panel, orders_panel

DIGITS = 8
LAGS = [1, 2, 5, 10, 20, 50]
WEIGHT_COUNT = 40
# Fixed values: (effect, candidate, reference) and (comparison, candidate, benchmark); the last two effects are bounds.
EFFECTS = [
    ("arfima_given_zero", "arfima+zero", "naive+zero"),
    ("arfima_given_naive", "arfima+naive", "naive+naive"),
    ("arfima_given_ar", "arfima+ar", "naive+ar"),
    ("naive_correction_given_naive", "naive+naive", "naive+zero"),
    ("ar_correction_given_naive", "naive+ar", "naive+zero"),
    ("naive_correction_given_arfima", "arfima+naive", "arfima+zero"),
    ("ar_correction_given_arfima", "arfima+ar", "arfima+zero"),
    ("complete_against_baseline", "arfima+ar", "naive+zero"),
    ("perfect_correction", "naive+oracle", "naive+zero"),
    ("perfect_indicator", "oracle+zero", "naive+zero"),
]
LOSS_PAIRS = [
    ("arfima_indicator_against_direct", "arfima+zero", forecast.DIRECT),
    ("naive_indicator_against_direct", "naive+zero", forecast.DIRECT),
    ("arfima_against_naive_indicator", "arfima+zero", "naive+zero"),
    ("residual_arfima", "arfima+arfima", "arfima+zero"),
    ("complete_arfima_against_direct", "arfima+arfima", forecast.DIRECT),
]
PRIMARY = (LOSS_PAIRS[0][0], "overall")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(rows: DataFrame, digits: int = DIGITS) -> DataFrame:
    return rows.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(function(spark, sf_dir))

    QUERIES[function.__name__] = run
    return function


def on_design(function: Callable[[Design], DataFrame]) -> Callable[[Design], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(function(lineitem_design(spark, sf_dir)))

    QUERIES[function.__name__] = run
    return function


# --- panels --------------------------------------------------------------------------------------------------------


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of money are exact to the cent, so prices agree to the last bit and need no rounding."""
    d = lineitem_design(spark, sf_dir)
    return panel.by_asset(d.panel.wide, "price", d.panel.assets, "price")


QUERIES["price_panel"] = price_panel


@on_design
def log_returns(d: Design) -> DataFrame:
    return panel.by_asset(d.returns, "r", d.panel.assets, "r")


@query
def validate_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.panel_report(lineitem_panel(spark, sf_dir).rows, 86_400)


@on_design
def data_audit(d: Design) -> DataFrame:
    return panel.audit(d.panel, BLOCK_SIZE)


@query
def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carried_forward(event_buckets(spark, sf_dir))


@query
def daily_normalised_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.sources.panels import Panel

    return figures.daily_normalised_close(Panel(event_buckets(spark, sf_dir), ()))


# --- matrices ------------------------------------------------------------------------------------------------------


@on_design
def block_covariances(d: Design) -> DataFrame:
    return mt.entry_rows(d.series.rows, d.panel.assets)


@query
def orders_block_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = orders_panel(spark, sf_dir)
    series = mt.block_covariances(panel.log_returns(bound), bound.assets, BLOCK_SIZE)
    return mt.entry_rows(series.rows, bound.assets)


@query
def orders_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = orders_panel(spark, sf_dir)
    series = mt.block_covariances(panel.log_returns(bound), bound.assets, BLOCK_SIZE)
    return mt.psd_table(series.rows.withColumn("method", F.lit("actual")), series.p, ["method"])


@on_design
def reference_covariance(d: Design) -> DataFrame:
    return reference.covariance_rows(d.spark, d.reference)


@on_design
def reference_pca(d: Design) -> DataFrame:
    return reference.pca_table(d.spark, d.reference)


@on_design
def dominant_indicator(d: Design) -> DataFrame:
    return mt.with_sample(reference.indicator(d.series, d.reference), d.training).select("k", "ts", "sample", "z")


@on_design
def matrices_in_basis(d: Design) -> DataFrame:
    """Sign-free part: squared entries in the reference basis."""
    rows = reference.in_basis(d.series, d.reference)
    squared = F.transform("m", lambda x: x * x)
    return mt.entry_rows(rows.select("k", "ts", squared.alias("m")), tuple(f"component_{k + 1}" for k in range(d.p)))


@on_design
def sample_bounds(d: Design) -> DataFrame:
    return evaluate.sample_bounds(mt.with_sample(d.series.rows, d.training))


@on_design
def approximation_errors(d: Design) -> DataFrame:
    return reference.interval_errors(d.errors, d.p)


@on_design
def approximation_summary(d: Design) -> DataFrame:
    return reference.approximation_summary(d.errors, d.p)


@on_design
def empirical_cdf(d: Design) -> DataFrame:
    return evaluate.empirical_cdf(reference.interval_errors(d.errors, d.p), F.col("interval_error"), ["sample"])


@on_design
def cdf_markers(d: Design) -> DataFrame:
    return figures.cdf_markers(reference.interval_errors(d.errors, d.p))


# --- forecasts and their evaluation --------------------------------------------------------------------------------


@on_design
def direct_naive_forecast(d: Design) -> DataFrame:
    return mt.entry_rows(d.direct.select("k", "ts", "f"), d.panel.assets, "f")


@on_design
def naive_indicator_forecast(d: Design) -> DataFrame:
    return mt.entry_rows(d.naive.select("k", "ts", "z_hat", "f"), d.panel.assets, "f")


@on_design
def rmse_by_method(d: Design) -> DataFrame:
    return d.rmse(d.all_methods())


@on_design
def rmse_reductions(d: Design) -> DataFrame:
    return evaluate.reductions(mt.rmse_table(d.all_methods(), d.p, ["method"]), forecast.DIRECT)


@on_design
def losses_by_timestamp(d: Design) -> DataFrame:
    return mt.losses(d.naive_methods, d.p).select("method", "k", "ts", "overall", "diagonal", "off_diagonal")


@on_design
def component_comparison(d: Design) -> DataFrame:
    table = evaluate.component_metrics(d.all_methods(), d.p, ["method"])
    return evaluate.against(table, forecast.DIRECT)


@on_design
def psd_diagnostics(d: Design) -> DataFrame:
    return mt.psd_table(d.all_methods(), d.p, ["method"], "f")


@on_design
def figure_guards(d: Design) -> DataFrame:
    """What must be zero before figures are drawn: shares that do not sum to one, and forecasts that are not definite."""
    return figures.check_before_plotting(reference.pca_table(d.spark, d.reference), mt.psd_table(d.all_methods(), d.p, ["method"], "f"))


@on_design
def scalar_forecast_metrics(d: Design) -> DataFrame:
    return evaluate.scalar_metrics(d.naive.select(F.lit("naive").alias("method"), F.col("z").alias("value"), "z_hat"), ["method"])


@on_design
def cumulative_loss_difference(d: Design) -> DataFrame:
    return d.differences.select("k", "ts", "diff", "cumulative")


@on_design
def cumulative_loss_differences(d: Design) -> DataFrame:
    """The paths of two figures and of the difference between them, in units of 1e-8."""
    rows, table = d.method_losses, None
    for candidate, benchmark in ((forecast.NAIVE, forecast.DIRECT), (forecast.ARFIMA, forecast.DIRECT), (forecast.ARFIMA, forecast.NAIVE)):
        part = evaluate.differences_of(rows, candidate, benchmark)
        part = part.select(F.lit(candidate).alias("candidate"), F.lit(benchmark).alias("benchmark"), "k", "ts", "diff", "cumulative")
        table = part if table is None else table.unionByName(part)
    return table


@on_design
def primary_loss_report(d: Design) -> DataFrame:
    """The fields of the concentration report, for the ARFIMA indicator against direct persistence."""
    return evaluate.loss_report(d.kept(evaluate.differences_of(d.method_losses, forecast.ARFIMA, forecast.DIRECT)))


@on_design
def win_share(d: Design) -> DataFrame:
    return evaluate.win_share(d.differences)


@on_design
def loss_concentration(d: Design) -> DataFrame:
    return evaluate.concentration(d.differences)


@on_design
def loss_summary(d: Design) -> DataFrame:
    return evaluate.gross(d.differences)


@on_design
def monthly_contributions(d: Design) -> DataFrame:
    return evaluate.monthly(d.differences)


@on_design
def extreme_events(d: Design) -> DataFrame:
    """A top-k report: ten gains and ten losses."""
    return evaluate.extreme_events(d.differences)


@on_design
def invariant_violations(d: Design) -> DataFrame:
    base = d.naive.select("k", "f")
    corrected = d.factorial.where("method = 'naive+naive'").select("k", "f")
    exact = d.factorial.where("method = 'naive+oracle'")
    # with the oracle indicator and coefficients the diagonal comes back
    whole = d.factorial.where("method = 'oracle+oracle'")
    checks = {
        "direct_is_previous": invariants.naive_violations(d.series, d.direct),
        "finite_forecasts": invariants.finite_violations(d.naive_methods),
        "corrections_keep_off_diagonal": invariants.off_diagonal_violations(base, corrected, d.p),
        "oracle_recovers_diagonal": invariants.oracle_diagonal_violations(whole, d.p),
        "losses_add_up": invariants.loss_violations(mt.losses(exact, d.p)),
        "unmatched_forecasts": forecast.unmatched(d.direct, d.naive).agg(F.count(F.lit(1)).alias("violations")),
    }
    series = d.indicator_series.drop("ts").unionByName(d.coefficients.drop("ts"))
    changed = series.withColumn("value", F.when(F.col("pos") == d.matrices - 1, F.col("value") + 1).otherwise(F.col("value")))
    means = series.where(F.col("pos") < d.training).groupBy("series").agg(F.avg("value").alias("mean"), F.avg(F.abs("value")).alias("size"))
    checks |= {
        "fits_use_training_only": invariants.fit_violations(timeseries.fit_series(series, d.training, refine=False), means, d.training),
        "forecasts_ignore_the_future": invariants.future_dependence(
            *[timeseries.forecast_series(s, d.training, refine=False, longest=d.matrices) for s in (series, changed)], d.matrices - 1
        ),
    }
    table = None
    for name, rows in checks.items():
        part = rows.select(F.lit(name).alias("invariant"), F.col("violations").cast("long").alias("violations"))
        table = part if table is None else table.unionByName(part)
    return table


# --- scalar series -------------------------------------------------------------------------------------------------


def _training_series(d: Design) -> DataFrame:
    return d.indicator_series.where(F.col("pos") < d.training).drop("ts")


@on_design
def periodogram(d: Design) -> DataFrame:
    return fourier.periodogram(_training_series(d), d.training).select("j", "omega", "power")


@on_design
def whittle_grid(d: Design) -> DataFrame:
    return timeseries.whittle_grid(fourier.periodogram(_training_series(d), d.training)).drop("series")


@on_design
def whittle_grid_minimum(d: Design) -> DataFrame:
    return timeseries.grid_minimum(timeseries.whittle_grid(fourier.periodogram(_training_series(d), d.training))).drop("series")


@on_design
def whittle_fit(d: Design) -> DataFrame:
    fits = timeseries.fit_series(_training_series(d))
    return fits.select("mean", "d", "innovation_variance", "objective", "positive_frequency_count", "grid_best_d", "boundary_warning")


@on_design
def whittle_grid_fit(d: Design) -> DataFrame:
    fits = timeseries.fit_series(_training_series(d), refine=False)
    return fits.select("mean", "grid_best_d", "innovation_variance", "objective", "positive_frequency_count", "boundary_warning")


@on_design
def fractional_weights(d: Design) -> DataFrame:
    """The first coefficients of (1 - L)^d at the fitted d of the indicator and of every residual coefficient."""
    series = d.indicator_series.drop("ts").unionByName(d.coefficients.drop("ts"))
    fits = timeseries.fit_series(series, d.training).select("series", "d", F.lit(WEIGHT_COUNT).cast("long").alias("n"))
    made = fourier.fractional_weights(fits).join(fits, "series")
    return made.select("series", "d", F.col("pos").alias("k"), "weight")


@on_design
def arfima_forecast(d: Design) -> DataFrame:
    return d.arfima().select("k", "ts", "z_hat")


@on_design
def arfima_rmse(d: Design) -> DataFrame:
    """At the grid's d, without refinement."""
    return d.rmse(d.all_methods(refine=False))


@on_design
def arfima_refined_rmse(d: Design) -> DataFrame:
    return d.rmse(d.all_methods())


@on_design
def fractional_difference(d: Design) -> DataFrame:
    made = timeseries.difference_series(d.indicator_series.drop("ts"), d.training, longest=d.matrices)
    return made.select(F.col("pos").alias("k"), F.col("value").alias("z"), "innovation")


@on_design
def lag_correlations(d: Design) -> DataFrame:
    return timeseries.lag_correlations(_training_series(d), LAGS).drop("series")


@on_design
def coefficient_lag_correlations(d: Design) -> DataFrame:
    rows = d.coefficients.where(F.col("pos") < d.training)
    return timeseries.lag_correlations(rows, LAGS)


@on_design
def d_stability(d: Design) -> DataFrame:
    """Estimates on half, three quarters and all of the training part; a share under twenty values, from which
    nothing can be estimated, has nulls."""
    fits = timeseries.fit_series(timeseries.shares_of_training(d.indicator_series.drop("ts"), d.training), None, short=True, longest=d.training)
    return fits.select(F.substring_index("series", "@", -1).cast("int").alias("percent"), "d", "boundary_warning")


@on_design
def ar_fit(d: Design) -> DataFrame:
    fits = timeseries.ar_fits(d.coefficients.drop("ts"), d.training, (1,))
    return fits.select("series", "intercept", F.get("phi", F.lit(0)).alias("phi"))


@on_design
def ar_order_selection(d: Design) -> DataFrame:
    return timeseries.order_comparison(d.coefficients.drop("ts"), d.training)


@on_design
def ar_forecast(d: Design) -> DataFrame:
    return evaluate.scalar_metrics(timeseries.ar_forecasts(d.coefficients.drop("ts"), d.training), ["series"])


@on_design
def ar_first_order_forecast(d: Design) -> DataFrame:
    return timeseries.ar_forecasts(d.coefficients.drop("ts"), d.training, (1,)).withColumnRenamed("pos", "k")


@on_design
def residual_arfima(d: Design) -> DataFrame:
    return evaluate.scalar_metrics(timeseries.forecast_series(d.coefficients.drop("ts"), d.training, longest=d.matrices), ["series"])


@on_design
def naive_coefficient_forecast(d: Design) -> DataFrame:
    return timeseries.naive_forecasts(d.coefficients, d.training).withColumnRenamed("pos", "k")


@on_design
def indicator_comparison(d: Design) -> DataFrame:
    """Persistence, the training mean, the fractional model, and the truth."""
    naive = d.naive.select(F.lit("naive").alias("method"), "k", F.col("z").alias("value"), "z_hat")
    mean = float(d.reference.eigenvalues[0])  # the training mean of the indicator
    fractional = timeseries.forecast_series(d.indicator_series.drop("ts"), d.training, longest=d.matrices)
    parts = [
        naive, naive.withColumns({"method": F.lit("training_mean"), "z_hat": F.lit(mean)}), naive.withColumns({"method": F.lit("oracle"), "z_hat": F.col("value")}),
        fractional.select(F.lit("arfima").alias("method"), F.col("pos").alias("k"), "value", "z_hat"),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return evaluate.scalar_metrics(table, ["method"]).select("method", "rmse", "mae", "bias", "squared_error", "min_forecast")


@on_design
def innovation_lag_correlations(d: Design) -> DataFrame:
    """Of the training innovations, without the first max(50, sqrt N), which the missing past still colours."""
    burn = max(50, int(d.training**0.5))
    made = timeseries.difference_series(d.indicator_series.drop("ts"), d.training, longest=d.matrices)
    kept = made.where((F.col("pos") >= burn) & (F.col("pos") < d.training)).select("series", (F.col("pos") - burn).alias("pos"), F.col("innovation").alias("value"))
    return timeseries.lag_correlations(kept, LAGS).drop("series")


@on_design
def coefficient_innovation_lag_correlations(d: Design) -> DataFrame:
    """Of the fractionally differenced training coefficients, per asset, from the first on."""
    made = timeseries.difference_series(d.coefficients.drop("ts"), d.training, longest=d.matrices).where(F.col("pos") < d.training)
    return timeseries.lag_correlations(made.select("series", "pos", F.col("innovation").alias("value")), LAGS)


@on_design
def prefix_refit_stability(d: Design) -> DataFrame:
    fits = timeseries.fit_series(d.prefix_coefficients((50, 75, 100)), None, short=True, longest=d.training)
    name, share = F.substring_index("series", "@", 1), F.substring_index("series", "@", -1).cast("int")
    return fits.select(name.alias("series"), share.alias("percent"), "d", "boundary_warning")


@on_design
def validation_selection(d: Design) -> DataFrame:
    """Order selection with the reference estimated before the validation part only."""
    start = timeseries.validation_start(d.training)
    early = Design(d.spark, d.panel, d.block_size, start)
    return timeseries.order_comparison(early.coefficients.drop("ts"), d.training)


# --- inference -----------------------------------------------------------------------------------------------------


@on_design
def hac_test(d: Design) -> DataFrame:
    """Without the p-value, which SQL lacks the function for; hac_sensitivity has it."""
    return inference.hac_rows(d.spark, inference.hac_tests(d.differences)).select("n", "lag", "mean", "long_run_variance", "standard_error", "t_statistic")


@on_design
def hac_sensitivity(d: Design) -> DataFrame:
    return inference.hac_rows(d.spark, inference.hac_sensitivity(d.differences))


@on_design
def hac_lags(d: Design) -> DataFrame:
    """hac_sensitivity without the p-value."""
    return inference.hac_rows(d.spark, inference.hac_sensitivity(d.differences)).select("lag", "n", "mean", "long_run_variance", "standard_error", "t_statistic")


@on_design
def untruncated_bootstrap_interval(d: Design) -> DataFrame:
    return inference.bootstrap_interval(d.differences, truncate=False)


@on_design
def loss_intervals(d: Design) -> DataFrame:
    """Bootstrap intervals of every loss pair i and component j, seeded with the base seed + 100 i + j, in one plan."""
    rows = [(name, c, inference.BASE_SEED + 100 * i + j) for i, (name, *_) in enumerate(LOSS_PAIRS) for j, c in enumerate(evaluate.COMPONENTS)]
    seeds, n = d.spark.createDataFrame(rows, "effect string, component string, seed long"), d.matrices - d.training
    return inference.bootstrap_table(d.pair_differences(LOSS_PAIRS), seeds, n, inference.automatic_block_length(n))


@on_design
def bootstrap_interval(d: Design) -> DataFrame:
    return inference.bootstrap_interval(d.differences)


@on_design
def block_length_sensitivity(d: Design) -> DataFrame:
    return inference.block_length_sensitivity(d.differences)


@on_design
def circular_block_sums(d: Design) -> DataFrame:
    return inference.circular_sums(d.differences, d.matrices - d.training, 5)


def _pair_tests(d: Design) -> DataFrame:
    return inference.hac_table(d.pair_differences(LOSS_PAIRS), ["effect", "component"], inference.automatic_hac_lag(d.matrices - d.training))


@on_design
def loss_tests(d: Design) -> DataFrame:
    """Equal-accuracy tests of every pair and component; losses that never differ have no statistic."""
    return _pair_tests(d).drop("p_value")


@on_design
def loss_test_probabilities(d: Design) -> DataFrame:
    return _pair_tests(d).select("effect", "component", "t_statistic", "p_value")


@on_design
def loss_difference_comparison(d: Design) -> DataFrame:
    """Every pair and component: means of the losses, how often the candidate wins, and the difference's lag-1
    correlation; a benchmark without loss is refused."""
    rows = with_lags(d.pair_differences(LOSS_PAIRS), {"before": ("diff", 1)}, ["effect", "component"])
    table = rows.groupBy("effect", "component").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("candidate_mean"), F.avg("b").alias("benchmark_mean"), F.avg("diff").alias("mean_difference"),
        F.avg(F.when(F.col("a") < F.col("b"), 1.0).otherwise(0.0)).alias("win_share"),
        panel.correlation("diff", "before").alias("lag_1_correlation"), F.bool_and(F.col("diff") == 0).alias("identical_losses"),
    )
    refused = F.raise_error(F.lit("a benchmark has zero mean loss")).cast("double")
    reduction = F.when(F.col("benchmark_mean") == 0, refused).otherwise(F.col("mean_difference") / F.col("benchmark_mean"))
    primary = (F.col("effect") == PRIMARY[0]) & (F.col("component") == PRIMARY[1])
    return table.select("*", reduction.alias("relative_reduction"), primary.alias("is_primary"))


# --- residuals -----------------------------------------------------------------------------------------------------


@on_design
def residual_coefficients(d: Design) -> DataFrame:
    return d.coefficients.withColumnRenamed("pos", "k")


@on_design
def complete_forecasts(d: Design) -> DataFrame:
    return evaluate.component_metrics(d.factorial, d.p, ["method"]).select("method", "component", "rmse")


@on_design
def incremental_effects(d: Design) -> DataFrame:
    table = evaluate.incremental_effects(evaluate.component_metrics(d.factorial, d.p, ["method"]), EFFECTS)
    return table.select("effect", "component", "candidate_rmse", "reference_rmse", "share_captured")


@on_design
def coefficient_split(d: Design) -> DataFrame:
    return residual.split_comparison(d.coefficients, d.training)


@on_design
def pair_rmse(d: Design) -> DataFrame:
    return residual.pair_rmse(d.naive_methods, d.panel.assets, forecast.NAIVE)


@on_design
def mean_error_norm(d: Design) -> DataFrame:
    return residual.mean_error_norm(d.errors, d.p, d.training)


@on_design
def residual_eigenvalues(d: Design) -> DataFrame:
    values = mx.eigenvalues(F.col("e"), d.p)
    return d.errors.select("k", F.posexplode(values).alias("place", "value")).withColumn("place", F.col("place") + 1)


@on_design
def basis_similarity(d: Design) -> DataFrame:
    """Absolute similarities of consecutive matched bases: free of sign."""
    rows = residual.consecutive(residual.matched(residual.decompositions(d.errors, d.p), d.p), d.p)
    return rows.select("k", F.posexplode(F.transform("similarity", F.abs)).alias("column", "similarity"))


@on_design
def previous_basis_errors(d: Design) -> DataFrame:
    rows = residual.consecutive(residual.matched(residual.decompositions(d.errors, d.p), d.p), d.p)
    return residual.share_remaining(rows, d.p)


@on_design
def moment_tensor(d: Design) -> DataFrame:
    tensor = residual.moment_tensor(d.errors, d.p, d.training)
    names = d.panel.assets
    upper = [(i, j) for i in range(d.p) for j in range(i, d.p)]
    rows = [(names[a], names[b], names[c], names[e], float(tensor[a, b, c, e])) for q, (a, b) in enumerate(upper) for c, e in upper[q:]]
    return d.spark.createDataFrame(rows, "a string, b string, c string, d string, value double")


@on_design
def joint_diagonalisation(d: Design) -> DataFrame:
    basis, value, start = bases.joint_basis(residual.moment_tensor(d.errors, d.p, d.training), d.reference.basis)
    rows = [(column, load, angle, float(value), start) for column, load, angle in bases.alignment(basis)]
    return rounded(d.spark.createDataFrame(rows, "column int, loading double, angle double, objective double, start string"), 5)


@on_design
def projection_share(d: Design) -> DataFrame:
    basis, _, _ = bases.joint_basis(residual.moment_tensor(d.errors, d.p, d.training), d.reference.basis)
    rows = mt.with_sample(residual.projected(d.errors, basis, d.p), d.training)
    left = F.sum(mx.squares(mx.minus(F.col("e"), F.col("approx"), d.p), d.p))
    return rounded(rows.groupBy("sample").agg(F.try_divide(left, F.sum(mx.squares(F.col("e"), d.p))).alias("share_remaining")), 5)


@on_design
def loss_ranks(d: Design) -> DataFrame:
    return ordering.ranked(d.differences, [], -F.col("diff"), "pos").select("k", F.col("rank").cast("int").alias("rank"))
