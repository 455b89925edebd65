"""Values that results depend on: word lists, maps, defaults, limits."""

# --- fixed values: columns of the customer feature table -------------------
YES_NO_COLUMNS = ["Partner", "Dependents", "PhoneService", "PaperlessBilling", "Churn"]
ADD_ON_COLUMNS = [
    "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
]
BUNDLE_COLUMNS = ["PhoneService", *ADD_ON_COLUMNS]
NO_SERVICE = {"No internet service": "No", "No phone service": "No"}
CONTRACT_CODES = {"Month-to-month": 0, "One year": 1, "Two year": 2}
MODEL_URGENCY_CODES = {"low": 0, "medium": 1, "high": 2, "critical": 3}
ROLLUP_URGENCY_CODES = {"low": 1, "medium": 2, "high": 3, "critical": 4}
BANK_COLUMNS = ["CreditScore", "Balance", "NumOfProducts", "EstimatedSalary"]
WHOLE_NUMBER_BANK_COLUMNS = ["CreditScore", "NumOfProducts"]
SCALED_COLUMNS = [
    "tenure", "MonthlyCharges", "TotalCharges", "CreditScore", "Balance", "EstimatedSalary",
]
CATEGORY_VALUES = {
    "PaymentMethod": [
        "Bank transfer (automatic)", "Credit card (automatic)",
        "Electronic check", "Mailed check",
    ],
    "InternetService": ["DSL", "Fiber optic", "No"],
}
PLAIN_COLUMNS = [
    "SeniorCitizen", "Partner", "Dependents", "PaperlessBilling",
    "contract_type_encoded", "service_bundle_size", "TechSupport", "OnlineSecurity",
    "logins_7d_rolling_avg", "logins_30d_rolling_avg", "login_trend",
    "support_contacts_30d", "days_since_last_login", "usage_delta_mom",
    "sentiment_score", "escalation_flag", "public_complaint_flag",
    "charges_per_tenure_month", "billing_delta_mom", "is_high_risk_contract",
    "ticket_sentiment_score", "ticket_complaint_topics_billing",
    "ticket_complaint_topics_competitor", "ticket_complaint_topics_performance",
    "ticket_escalation_flag", "review_sentiment_monthly", "urgency_level_encoded",
    "competitor_news_volume_7d", "public_review_sentiment_monthly",
    "one_star_review_rate_monthly", "price_competitiveness_ratio",
    "competitor_promotion_flag",
]

# --- fixed values: what a missing input counts as when scoring -------------
SCORING_DEFAULTS = {
    "tenure": 0.0, "MonthlyCharges": 0.0, "TotalCharges": 0.0,
    "CreditScore": 650.0, "Balance": 50000.0, "NumOfProducts": 1.0, "EstimatedSalary": 80000.0,
    "SeniorCitizen": 0.0, "Partner": 0.0, "Dependents": 0.0, "PhoneService": 0.0,
    "PaperlessBilling": 0.0, "contract_type_encoded": 0.0, "service_bundle_size": 1.0,
    "TechSupport": 0.0, "OnlineSecurity": 0.0,
    "logins_7d_rolling_avg": 0.5, "logins_30d_rolling_avg": 0.5, "login_trend": 0.0,
    "support_contacts_30d": 0.0, "days_since_last_login": 5.0, "usage_delta_mom": 0.0,
    "sentiment_score": 0.0, "escalation_flag": 0.0, "public_complaint_flag": 0.0,
    "charges_per_tenure_month": 10.0, "billing_delta_mom": 0.0, "is_high_risk_contract": 0.0,
    "ticket_sentiment_score": 0.0, "ticket_complaint_topics_billing": 0.0,
    "ticket_complaint_topics_competitor": 0.0, "ticket_complaint_topics_performance": 0.0,
    "ticket_escalation_flag": 0.0, "review_sentiment_monthly": 0.05,
    "urgency_level_encoded": 0.0, "competitor_news_volume_7d": 15.0,
    "public_review_sentiment_monthly": 0.12, "one_star_review_rate_monthly": 0.08,
    "price_competitiveness_ratio": 1.0, "competitor_promotion_flag": 0.0,
}
SCORING_CATEGORY_DEFAULTS = {"PaymentMethod": "Mailed check", "InternetService": "No"}

# --- fixed values: ticket rollup when a customer has no ticket -------------
TICKET_DEFAULTS = {
    "ticket_sentiment_score": 0.0,
    "ticket_urgency_level": "low",
    "ticket_complaint_topics_billing": 0,
    "ticket_complaint_topics_competitor": 0,
    "ticket_complaint_topics_performance": 0,
    "ticket_escalation_flag": 0,
}

# --- fixed values: snapshot groups -----------------------------------------
GROUP_COLUMNS = {
    "demographic": [
        "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
        "CreditScore", "Balance", "NumOfProducts", "EstimatedSalary", "tenure_band", "Churn",
    ],
    "behavioral": [
        "customerID", "service_bundle_size", "TechSupport", "OnlineSecurity",
        "logins_7d_rolling_avg", "logins_30d_rolling_avg", "login_trend",
        "support_contacts_30d", "days_since_last_login", "usage_delta_mom",
        "sentiment_score", "urgency_level", "escalation_flag", "public_complaint_flag",
    ],
    "billing": [
        "customerID", "MonthlyCharges", "TotalCharges", "charges_per_tenure_month",
        "billing_delta_mom", "contract_type_encoded", "PaperlessBilling",
        "is_high_risk_contract", "PaymentMethod", "InternetService",
    ],
    "llm_features": [
        "customerID", "ticket_sentiment_score", "ticket_urgency_level",
        "ticket_complaint_topics_billing", "ticket_complaint_topics_competitor",
        "ticket_complaint_topics_performance", "ticket_escalation_flag",
        "review_sentiment_monthly",
    ],
    "market_signals": [
        "customerID", "competitor_news_volume_7d", "public_review_sentiment_monthly",
        "one_star_review_rate_monthly", "price_competitiveness_ratio",
        "competitor_promotion_flag",
    ],
}
CONSTANT_BY_DESIGN = [
    "public_complaint_flag", "review_sentiment_monthly", "competitor_news_volume_7d",
    "public_review_sentiment_monthly", "one_star_review_rate_monthly",
    "competitor_promotion_flag",
]

# --- fixed values: limits --------------------------------------------------
MAX_NULL_RATE = 0.05
MAX_LABEL_CORRELATION = 0.95
MIN_KEY_OVERLAP = 0.10
MISSED_CHURNER_COST = 1680
CONTACT_COST = 50
DECISION_THRESHOLD = 0.32
HIGH_SCORE = 0.70
PRICE_SENSITIVE_CHARGE = 80.0
PSI_WARN, PSI_ALERT = 0.10, 0.20
PSI_FLOOR, PSI_EDGE_MARGIN = 1e-4, 1e-5
MAX_AUC_DECAY = 0.05
MIN_DECAY_ROWS = 10
PROMOTION_MARGIN = 0.02
PROMOTION_MIN_ROC, PROMOTION_MIN_RECALL = 0.84, 0.80


def one_hot_names() -> list[str]:
    return [f"{column}_{value}" for column, values in CATEGORY_VALUES.items() for value in values]


def model_columns() -> list[str]:
    """The model vector in its fixed order."""
    return [*SCALED_COLUMNS, *one_hot_names(), *PLAIN_COLUMNS]
