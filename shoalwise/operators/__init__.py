from shoalwise.operators.accumulation import accumulation, rarefaction
from shoalwise.operators.community import (
    composition,
    diversity,
    occurrence,
    regional_diversity,
    regional_richness,
    richness,
    species_totals,
    turnover_rate,
    turnover_years,
    with_region,
)
from shoalwise.operators.crosscorr import cross_correlation
from shoalwise.operators.environment import environment_means, with_oxygen_percent
from shoalwise.operators.ordered import exact_quantiles
from shoalwise.operators.gaussian import GaussianSmooth, gaussian_smooth
from shoalwise.operators.poisson import (
    Factor,
    Harmonic,
    PoissonFits,
    Smooth,
    fit_poisson,
    model_selection,
    one_by_one,
    poisson_gam,
    poisson_glm,
)
from shoalwise.operators.ranktrend import mann_kendall
from shoalwise.operators.regression import (
    ols,
    ols_line,
    ols_summary,
    percent_change,
    polynomial_values,
    reference_line,
    trend,
    trend_band,
    vif,
    weighted_polynomial,
)
from shoalwise.operators.reshape import (
    align_series,
    drop_index_column,
    join_covariates,
    lengthen,
    nan_to_null,
    order_labels,
    repeat_rows,
    split_id,
    widen,
    zero_fill,
)
from shoalwise.operators.smooth import bandwidths, density, local_smooth, local_smooth_band
from shoalwise.operators.timeline import complete_calendar
from shoalwise.operators.traits import (
    error_bars,
    latitude_trend,
    length_distribution,
    length_trend,
    mean_and_error,
    mean_log_length,
    metric_panel,
    split_metric_names,
    trait_trend,
)

__all__ = [
    "Factor",
    "Harmonic",
    "PoissonFits",
    "Smooth",
    "accumulation",
    "align_series",
    "bandwidths",
    "complete_calendar",
    "composition",
    "cross_correlation",
    "density",
    "diversity",
    "drop_index_column",
    "environment_means",
    "error_bars",
    "exact_quantiles",
    "fit_poisson",
    "gaussian_smooth",
    "GaussianSmooth",
    "join_covariates",
    "latitude_trend",
    "length_distribution",
    "length_trend",
    "lengthen",
    "local_smooth",
    "local_smooth_band",
    "mann_kendall",
    "mean_and_error",
    "mean_log_length",
    "metric_panel",
    "model_selection",
    "nan_to_null",
    "order_labels",
    "occurrence",
    "ols",
    "ols_line",
    "ols_summary",
    "one_by_one",
    "percent_change",
    "poisson_gam",
    "poisson_glm",
    "polynomial_values",
    "rarefaction",
    "reference_line",
    "regional_diversity",
    "regional_richness",
    "repeat_rows",
    "richness",
    "species_totals",
    "split_id",
    "split_metric_names",
    "trait_trend",
    "trend",
    "trend_band",
    "turnover_rate",
    "turnover_years",
    "vif",
    "weighted_polynomial",
    "widen",
    "with_oxygen_percent",
    "with_region",
    "zero_fill",
]
