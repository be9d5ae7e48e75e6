"""Explicit schemas of the landed files and of the mart."""

from __future__ import annotations

REVIEWS = "review string, rating int, date timestamp, likes int, source_type string"

# Mart tables. NOT NULL and CHECK rules are audited by operators.mart.constraint_violations.
MART = {
    "runs": "run_id string, created_at timestamp, data_mode string, source_type string, "
    "gate_status string, agent_results string",
    "reviews": "run_id string, review string, rating smallint, review_date date, likes int, "
    "source_type string, tokens string",
    "painpoints": "run_id string, topic string, freq int, avg_rating decimal(4,2), "
    "mention_all_neg decimal(5,1), mention_assigned decimal(5,1), rep_review string",
    "strengths": "run_id string, topic string, freq int, avg_rating decimal(4,2), rep_review string, "
    "rating smallint, likes int",
    "competitor_reviews": "run_id string, review string, rating smallint, review_date date, app string",
    "segments": "run_id string, respondent_id int, devices_owned smallint, app_freq smallint, "
    "age_band smallint, has_child smallint, is_renter smallint, move_plan decimal(2,1), "
    "bought_wedding smallint, p1_exp smallint, p2_exp smallint, p3_burden smallint, "
    "has_watch smallint, night_use smallint, onbody_intent smallint, pay_intent smallint, "
    "segment smallint, is_synthetic boolean",
    "testimony": "run_id string, testimony string",
}

NOT_NULL = {
    "runs": ("run_id", "created_at", "data_mode", "source_type", "gate_status"),
    "reviews": ("run_id", "review"),
    "painpoints": ("run_id", "topic"),
    "strengths": ("run_id",),
    "competitor_reviews": ("run_id", "app"),
    "segments": ("run_id", "respondent_id", "is_synthetic"),
    "testimony": ("run_id", "testimony"),
}
DEFAULT_APP = "rival"

# What the landed tables call a mart column, where the names differ.
LANDED_AS = {
    "reviews": {"review_date": "date"},
    "painpoints": {"mention_all_neg": "mention_all_pct", "mention_assigned": "mention_assigned_pct"},
    "strengths": {"rep_review": "review"},
    "competitor_reviews": {"review_date": "date"},
    "segments": {
        "app_freq": "app_frequency",
        "bought_wedding": "wedding_purchase",
        "p1_exp": "p1_experience",
        "p2_exp": "p2_experience",
        "has_watch": "owns_watch",
    },
    "testimony": {"testimony": "text"},
}
# Columns a landed table may lack; they are NULL then, but for the app.
OPTIONAL = {
    "runs": ("agent_results",),
    "strengths": ("topic", "freq", "avg_rating", "rating", "likes"),
    "competitor_reviews": ("app",),
}

LINEAGE_META = (
    "run_id string, status string, source_type string, app_id string, warning string, "
    "raw_csv_hash string, clean_csv_hash string, painpoints_csv_hash string, "
    "strengths_csv_hash string, sentiment_method string, topic_method string, "
    "negative_count int, noise_count int, n_reviews int, collected_at string, _corrupt_record string"
)
RUN_MANIFEST = (
    "run_id string, created_at timestamp, data_mode string, source_type string, "
    "gate_status string, agents map<string,string>, gate_failures array<string>"
)
EMBEDDING_MANIFEST = "document_hash string, row_count bigint, sbert_model string, sbert_available boolean"
SEARCH_PAGE = (
    "axis string, query string, origin string, "
    "items array<struct<title:string,description:string,link:string>>"
)
REVIEW_PAGE = "content string, score int, at timestamp, thumbsUpCount int"
