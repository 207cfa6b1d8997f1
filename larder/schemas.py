"""The domain's tables as explicit Spark schemas; money and nutrients are decimals, times are UTC."""

from __future__ import annotations

_NUTRIENTS = "calories decimal(8,2), protein decimal(8,2), fat decimal(8,2), carbohydrate decimal(8,2), sodium decimal(8,2), fiber decimal(8,2)"

# DDL, which readers and createDataFrame take as it is.
TABLES = {
    "students": "id int, student_no string, name string, class_id string, class_name string, grade_id string, grade_name string, card_no string, is_active boolean, created_at timestamp",
    "users": "id int, external_id string, username string, name string, role string, dept_id string, dept_name string, managed_class_ids array<string>, managed_grade_ids array<string>, student_ids array<int>, is_active boolean, sync_at timestamp, created_at timestamp, updated_at timestamp",
    "dishes": f"id int, name string, description string, ingredients string, image_url string, price decimal(8,2), category string, weight decimal(8,2), {_NUTRIENTS}, is_active boolean, created_at timestamp, updated_at timestamp",
    "dish_sample_images": "id int, dish_id int, image_path string, original_filename string, sort_order int, is_cover boolean, is_active boolean, embedding_status string, embedding_model string, embedding_version string, embedding_updated_at timestamp, error_message string, created_at timestamp, updated_at timestamp",
    "daily_menus": "id int, menu_date date, meal_dish_ids map<string, array<int>>, is_default boolean, created_by int, created_at timestamp, updated_at timestamp",
    "captured_images": "id int, capture_date date, channel_id string, captured_at timestamp, image_path string, status string, source_video string, diff_score double, is_candidate boolean, created_at timestamp",
    "dish_recognitions": "id int, image_id int, dish_id int, dish_name_raw string, confidence decimal(4,3), is_low_confidence boolean, is_manual boolean, model_version string, raw_response string, created_at timestamp",
    "consumption_records": "id int, student_id int, student_no string, student_name string, transaction_time timestamp, amount decimal(8,2), transaction_id string, import_batch string, created_at timestamp",
    "match_results": "id int, consumption_record_id int, image_id int, student_id int, status string, time_diff_seconds double, price_diff double, is_manual boolean, confirmed_by int, confirmed_at timestamp, match_date date, created_at timestamp",
    "nutrition_logs": "id int, student_id int, log_date date, nutrient_totals map<string, double>, meal_count int, dish_ids array<int>, created_at timestamp, updated_at timestamp",
    "reports": "id int, report_type string, target_id string, period_start date, period_end date, content string, summary string, push_status string, pushed_at timestamp, push_retry_count int, created_at timestamp",
    "report_push_logs": "id int, report_id int, user_id int, status string, error_message string, pushed_at timestamp",
    "task_logs": "id int, task_type string, task_date date, status string, total_count int, success_count int, low_confidence_count int, error_count int, error_message string, meta map<string, string>, started_at timestamp, finished_at timestamp",
    "video_sources": "id int, name string, source_type string, is_active boolean, status string, config_json string, credentials_json_encrypted string, last_validation_status string, last_validation_error string, last_validated_at timestamp, created_at timestamp, updated_at timestamp",
}

# What each column of states may hold.
STATES = {
    "embedding_status": ["pending", "processing", "ready", "failed"],
    "image_status": ["pending", "identified", "matched", "error"],
    "match_status": ["matched", "time_matched_only", "unmatched_image", "unmatched_record", "confirmed"],
    "role": ["admin", "teacher", "grade_leader", "parent", "student"],
}

NUTRIENTS = ["calories", "protein", "fat", "carbohydrate", "sodium", "fiber"]

# Recommended intake of a day.
RECOMMENDED = {"calories": 2000.0, "protein": 60.0, "fat": 65.0, "carbohydrate": 275.0, "sodium": 2000.0, "fiber": 25.0}
