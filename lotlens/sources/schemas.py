"""Logical schemas of the marketplace tables, as DDL; every column may be null in storage."""

FILTERS = "struct<brand:string,model:string,year_from:int,year_to:int,price_from:int,price_to:int,mileage_from:int,mileage_to:int,fuel:array<string>,transmission:array<string>,region:string,sources:array<string>>"

USERS = """id string, email string, name string, hashed_password string, google_id string, telegram_id string, telegram_username string,
    telegram_avatar_path string, plan string, plan_expires_at timestamp, trial_ends_at timestamp, telegram_connected boolean,
    onboarding_completed boolean, is_active boolean, created_at timestamp"""
SEARCH_QUERIES = f"id string, user_id string, name string, filters {FILTERS}, is_active boolean, new_count int, total_count int, last_checked_at timestamp, created_at timestamp"
LISTINGS = """id string, external_id string, source string, title string, brand string, model string, year int, price int, currency string,
    mileage int, fuel string, transmission string, region string, description string, url string, images array<string>, seller_name string,
    seller_type string, price_history array<map<string,string>>, is_duplicate boolean, duplicate_of string, published_at timestamp, found_at timestamp"""
FAVORITES = "id string, user_id string, listing_id string, created_at timestamp"
NOTIFICATIONS = """id string, user_id string, type string, title string, body string, listing_id string, search_id string,
    payload struct<price:int,year:int,mileage:int,region:string,source:string,source_label:string,url:string>, is_read boolean, sent_telegram boolean, created_at timestamp"""
KV = "key string, value string, expires_at double"
#: Later versions of a table add columns; older files read as null there.
ADDED = {"users": {2: ("telegram_username", "onboarding_completed", "is_active"), 3: ("telegram_avatar_path",)}}
