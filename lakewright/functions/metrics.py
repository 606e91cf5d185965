"""Direction of a metric: whether higher or lower is better, from its name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakewright.functions.text import metric_name

# fixed values: metric names by direction, and the prefixes and suffixes that the rule looks at
HIGHER = (
    "accuracy", "acc", "acc_norm", "accuracy_norm", "f1", "f1_macro", "f1_micro", "f1_weighted", "precision",
    "recall", "exact_match", "em", "matthews_correlation", "mcc", "kappa", "cohen_kappa", "balanced_accuracy",
    "top_k_accuracy", "auc", "roc_auc", "pr_auc", "average_precision", "ap", "map", "mrr", "ndcg", "dcg", "hit_rate",
    "hits", "success_rate", "pass", "pass_rate", "bleu", "sacrebleu", "chrf", "chrf++", "rouge", "rouge1", "rouge2",
    "rougel", "rougelsum", "meteor", "bertscore", "bleurt", "comet", "ter_score", "gleu", "sari", "cider", "spice",
    "pearson", "spearman", "kendall", "cosine_similarity", "similarity", "v_measure", "ari", "nmi", "silhouette",
    "purity", "main_score", "iou", "miou", "dice", "psnr", "ssim", "map50", "map75",
)
LOWER = (
    "wer", "cer", "per", "ter", "mer", "wil", "edit_distance", "levenshtein", "loss", "eval_loss", "train_loss",
    "validation_loss", "perplexity", "ppl", "nll", "cross_entropy", "mae", "mse", "rmse", "mape", "smape", "msle",
    "error", "error_rate", "err", "eer", "fid", "kid", "lpips", "brier", "word_error_rate", "character_error_rate",
    "char_error_rate",
)
REWARD = (
    "mean_reward", "reward", "episode_reward", "episodic_reward", "return", "mean_return", "avg_reward",
    "average_reward", "score_reward",
)
PREFIXES = ("cosine_", "cos_sim_", "euclidean_", "manhattan_", "dot_", "max_", "l2_", "ip_")
DIAGNOSTIC = "^naucs?_"


def metric_base(name: Column) -> Column:
    """A normal name without its cut-off and its first similarity prefix."""
    cut = F.regexp_replace(name, r"_at_\d+$", "")
    return F.coalesce(F.nullif(F.regexp_extract(cut, f"^(?:{'|'.join(PREFIXES)})(.+)$", 1), F.lit("")), cut)


def direction(raw: Column) -> Column:
    """higher, lower, reward or unknown; rewards are told first, and nothing is guessed."""
    name = metric_name(raw)
    base = metric_base(name)
    return (
        F.when(name.isNull() | (name == "") | name.rlike(DIAGNOSTIC), "unknown")
        .when(base.isin(*REWARD) | name.isin(*REWARD), "reward")
        .when(base.isin(*HIGHER), "higher")
        .when(base.isin(*LOWER), "lower")
        .otherwise("unknown")
    )


def known(direction: Column, merged: bool = False) -> Column:
    """Whether a direction makes a query eligible; merged sources also have curated ones."""
    return direction.isin("higher", "lower", *(("curated",) if merged else ()))


def orient(weight: Column, direction: Column) -> Column:
    """1 - weight where lower is better."""
    return F.when(direction == "lower", 1 - weight).otherwise(weight)
