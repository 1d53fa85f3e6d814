"""Schemas of the stored tables and of the nested lead record."""

from __future__ import annotations

COMPANY_FIELDS = {"id": "bigint", **{c: "string" for c in (
    "name", "domain", "industry", "size", "location", "website", "description", "linkedin_url", "phone", "revenue")},
    "technologies": "array<string>", "social_media": "map<string,string>"}
LEAD_FIELDS = {"id": "bigint", **{c: "string" for c in (
    "first_name", "last_name", "email", "phone", "title", "linkedin_url", "twitter_url", "github_url", "facebook_url", "website", "source", "status", "notes")},
    "created_at": "timestamp", "updated_at": "timestamp"}
COMPANY = "struct<" + ",".join(f"{k}:{v}" for k, v in COMPANY_FIELDS.items()) + ">"
LEAD_IMPORT = ", ".join(f"{k} {v}" for k, v in LEAD_FIELDS.items()) + f", company {COMPANY}"

# Schema texts, usable wherever Spark takes a schema.
TABLES = {
    "users": "id bigint, email string, username string, is_active boolean, is_premium boolean, created_at timestamp",
    "companies": "id bigint, name string, domain string, industry string, size string, location string, description string, website string, linkedin_url string, phone string, revenue string, technologies string, social_media string, created_at timestamp, updated_at timestamp",
    "leads": "id bigint, first_name string, last_name string, email string, phone string, title string, linkedin_url string, twitter_url string, source string, status string, score double, notes string, tags string, company_id bigint, owner_id bigint, campaign_id bigint, created_at timestamp, updated_at timestamp",
    "campaigns": "id bigint, name string, description string, target_criteria string, status string, owner_id bigint, created_at timestamp, updated_at timestamp",
    "lead_predictions": "id bigint, lead_id bigint, model_type string, model_version string, prediction_score double, confidence double, explanation string, feature_importance string, raw_features string, processing_time_ms double, created_at timestamp",
    "data_quality_scores": "id bigint, lead_id bigint, overall_score double, email_quality double, completeness_score double, accuracy_score double, consistency_score double, freshness_score double, issues_found string, suggestions string, quality_trend string, previous_score double, improvement_potential double, assessment_method string, created_at timestamp",
    "lead_insights": "id bigint, lead_id bigint, insight_type string, insight_category string, insight_text string, action_items string, priority_level string, confidence_score double, impact_score double, urgency_score double, status string, user_feedback string, created_at timestamp",
    "model_metadata": "id bigint, model_name string, model_type string, purpose string, version string, algorithm string, accuracy double, precision double, recall double, f1_score double, r2_score double, training_samples bigint, training_date timestamp, is_active boolean, predictions_made bigint",
    "lead_similarities": "lead_id_1 bigint, lead_id_2 bigint, similarity_score double, similarity_type string, matching_features string, confidence double, business_relevance double",
    "duplicate_detections": "id bigint, primary_lead_id bigint, duplicate_lead_id bigint, match_score double, match_type string, matching_fields string, auto_merge_recommended boolean, status string, detected_at timestamp",
    "ai_processing_logs": "id bigint, operation_type string, entity_type string, entity_id bigint, model_name string, processing_status string, start_time timestamp, end_time timestamp, processing_duration_ms double, cpu_usage_percent double, memory_usage_mb double, user_id bigint, batch_id string, details string",
    "ai_feedback": "id bigint, prediction_id bigint, insight_id bigint, user_id bigint, rating int, is_accurate boolean, is_helpful boolean, actual_outcome string, sentiment string, created_at timestamp",
    "optimal_contact_timing": "lead_id bigint, best_day_of_week string, best_hour_start int, best_hour_end int, timezone string, confidence_score double, historical_success double, last_updated timestamp",
    "enrichment_suggestions": "id bigint, lead_id bigint, missing_field string, suggested_value string, confidence_score double, priority string, estimated_impact double, status string, expires_at timestamp",
}
