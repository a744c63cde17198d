"""Table schemas, enum domains and fixed message texts.

FIXED VALUES: the status names, permission slugs, log levels / categories and the error
texts below must equal the service's own strings for results to line up; they are stated
here once, in natural order, and every operator refers to these names.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- table schemas
S = T.StringType()
TS = T.TimestampType()

VIDEOS = T.StructType([
    T.StructField("id", S), T.StructField("title", S), T.StructField("description", S),
    T.StructField("duration", T.LongType()),            # nanoseconds, never an interval type
    T.StructField("filename", S), T.StructField("resource_id", S), T.StructField("status", S),
    T.StructField("created_at", TS), T.StructField("updated_at", TS),
])
JOBS = T.StructType([
    T.StructField("id", S), T.StructField("video_id", S), T.StructField("type", S),
    T.StructField("status", S), T.StructField("result", S), T.StructField("error_msg", S),
    T.StructField("created_at", TS), T.StructField("updated_at", TS),
])
USERS = T.StructType([
    T.StructField("id", S), T.StructField("email", S), T.StructField("username", S),
    T.StructField("password_hash", S), T.StructField("created_at", TS), T.StructField("updated_at", TS),
])
ROLES = T.StructType([T.StructField("id", S), T.StructField("name", S)])
PERMISSIONS = T.StructType([T.StructField("id", S), T.StructField("slug", S)])
USER_ROLES = T.StructType([T.StructField("user_id", S), T.StructField("role_id", S)])
ROLE_PERMISSIONS = T.StructType([T.StructField("role_id", S), T.StructField("permission_id", S)])

TABLES = {
    "videos": VIDEOS, "jobs": JOBS, "users": USERS, "roles": ROLES, "permissions": PERMISSIONS,
    "user_roles": USER_ROLES, "role_permissions": ROLE_PERMISSIONS,
}
PRIMARY_KEYS = {
    "videos": ["id"], "jobs": ["id"], "users": ["id"], "roles": ["id"], "permissions": ["id"],
    "user_roles": ["user_id", "role_id"], "role_permissions": ["role_id", "permission_id"],
}
UNIQUE_KEYS = {"users": [["email"], ["username"]], "roles": [["name"]], "permissions": [["slug"]]}

# Progress event as published: Go field names as JSON keys (no tags).
PROGRESS_EVENT = T.StructType([
    T.StructField("TotalFrames", T.LongType()), T.StructField("CurrentFrames", T.LongType()),
    T.StructField("Status", S), T.StructField("Percentage", T.IntegerType()),
])
# Log envelope, key order as emitted.
LOG_EVENT = T.StructType([
    T.StructField("category", S), T.StructField("level", S),
    T.StructField("message", S), T.StructField("source_id", S),
])

# ---------------------------------------------------------------- FIXED VALUES
VIDEO_PENDING, VIDEO_PROCESSING, VIDEO_PUBLISHED, VIDEO_FAILED, VIDEO_ARCHIVED = (
    "pending", "processing", "published", "failed", "archived")
VIDEO_STATUSES = [VIDEO_PENDING, VIDEO_PROCESSING, VIDEO_PUBLISHED, VIDEO_FAILED, VIDEO_ARCHIVED]

JOB_PENDING, JOB_RUNNING, JOB_COMPLETED, JOB_FAILED = "pending", "running", "completed", "failed"
JOB_STATUSES = [JOB_PENDING, JOB_RUNNING, JOB_COMPLETED, JOB_FAILED]
JOB_TYPE_TRANSCODE = "transcode"
JOB_TYPES = [JOB_TYPE_TRANSCODE]

PROGRESS_CONTINUE, PROGRESS_END, PROGRESS_ERROR = "continue", "end", "error"
PROGRESS_TERMINAL = [PROGRESS_END, PROGRESS_ERROR]

LOG_LEVELS = ["info", "warn", "error"]
LOG_CATEGORIES = ["default", "video", "job", "auth"]

PERMISSION_SLUGS = ["video:upload", "video:update", "video:archive"]

PAGE_SIZE = 10
WORKER_LIMIT = 5
ACCESS_TTL_MINUTES = 15
REFRESH_TTL_DAYS = 7

# Rejection texts of the domain rules.
ERR_VIDEO_ID_EMPTY = "video id cannot be empty"
ERR_FILENAME_EMPTY = "file name cannot be empty"
ERR_RESOURCE_ID_EMPTY = "resource id cannot be empty"
ERR_VIDEO_CANNOT_PROCESS = "video cannot be marked as processing"
ERR_VIDEO_CANNOT_FAIL = "video cannot be marked as failed"
ERR_VIDEO_CANNOT_PUBLISH = "video cannot be published"
ERR_VIDEO_CANNOT_ARCHIVE = "video cannot be archived"
ERR_TITLE_EMPTY = "video title cannot be empty"
ERR_DESCRIPTION_EMPTY = "video description cannot be empty"
ERR_DURATION_SET = "video duration has already been set"
ERR_DURATION_NEGATIVE = "video duration cannot be negative"

ERR_JOB_ID_EMPTY = "job id cannot be empty"
ERR_JOB_VIDEO_ID_EMPTY = "video id cannot be empty"
ERR_JOB_TYPE_INVALID = "job type is invalid"
ERR_JOB_CANNOT_START = "job cannot be started"
ERR_JOB_CANNOT_COMPLETE = "job cannot be completed"
ERR_JOB_CANNOT_FAIL = "job cannot be marked as failed"

ERR_USER_ID_EMPTY = "user id cannot be empty"
ERR_EMAIL_EMPTY = "email cannot be empty"
ERR_USERNAME_EMPTY = "username cannot be empty"
ERR_PWD_HASH_EMPTY = "password hash cannot be empty"
ERR_EMAIL_EXISTS = "email already exists"
ERR_USERNAME_EXISTS = "username already exists"

ERR_PROBE_PARSE = "parse ffprobe output"
ERR_PROBE_DURATION = "parse duration from ffprobe output"
ERR_PROBE_FRAMES = "parse frames from ffprobe output"
ERR_UNMARSHAL = "unmarshal progress"
ERR_TOTAL_FRAMES_ZERO = "total frames cannot be zero"
ERR_PROGRESS_CANNOT_UPDATE = "current frames cannot be updated"

ERR_VIDEO_NOT_FOUND = "video not found"
ERR_JOB_NOT_FOUND = "job not found"
ERR_SLUG_NULL = "slug cannot be null"
ERR_ROLE_NOT_FOUND = "cannot find role id"
ERR_MISSING_USER_ID = "missing user id"
ERR_TOKEN_EXPIRED = "token is expired"
ERR_INVALID_TOKEN_FORMAT = "invalid token format"
ERR_UNAUTHORIZED = "unauthorized"
ERR_INVALID_PATH = "invalid path"
