from .curves import (
    average_precision, get_prc_curve_df, get_prc_curve_df_single, get_prc_step_curve, get_prc_step_curve_df,
    get_prc_step_curve_df_single, prc_curve, prc_step_curve, scores_long, step_points,
)
from .distributions import (
    beta_params, beta_sample, nb_apply, nb_fit, nb_reparameterise, nb_sample, nb_score, normal_sample,
)
from .featuresets import join_featuresets, transform_featureset
from .masked import (
    MaskedDataset, core_dim_labels_from_mask, dataset_masked_indexing, dense_array, subset_variable,
)
from .matching import fuzzy_match_names, fuzzy_match_to_reference, normal_form, str_normalize
from .models import (
    BinaryClassifier, ModelWrapper, NullRegressor, ZscoreRegressor, fit_model, row_mean, score_model,
)
from .reshape import (
    displayHead, display_head, flatten, head, melt, normalise_fields_names, rename_column_values, rename_nested_fields,
    zip_explode_cols,
)

__all__ = [
    "BinaryClassifier", "MaskedDataset", "ModelWrapper", "NullRegressor", "ZscoreRegressor", "average_precision",
    "beta_params", "beta_sample", "core_dim_labels_from_mask", "dataset_masked_indexing", "dense_array",
    "displayHead", "display_head", "fit_model", "flatten", "fuzzy_match_names", "fuzzy_match_to_reference", "get_prc_curve_df",
    "get_prc_curve_df_single", "get_prc_step_curve", "get_prc_step_curve_df", "get_prc_step_curve_df_single",
    "head", "join_featuresets", "melt", "nb_apply", "nb_fit", "nb_reparameterise", "nb_sample", "nb_score",
    "normal_form", "normal_sample", "normalise_fields_names", "prc_curve", "prc_step_curve",
    "rename_column_values", "rename_nested_fields", "row_mean", "score_model", "scores_long", "step_points",
    "str_normalize", "subset_variable", "transform_featureset", "zip_explode_cols",
]
