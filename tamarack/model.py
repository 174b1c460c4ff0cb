"""Schemas of the engine's tables."""

from __future__ import annotations

RAW_JOB = (
    "sourceId string, url string, title string, company string, companyLogoUrl string, location string, remote string, employmentType string, salaryMin double, salaryMax double, "
    "salaryPeriod string, description string, tags array<string>, postedAt string"
)
JOB = (
    "id string, sourceId string, url string, title string, company string, companyLogoUrl string, location string, regionId string, city string, remote string, categoryId string, "
    "employmentType string, salaryMin double, salaryMax double, salaryPeriod string, currency string, description string, tags array<string>, languages array<string>, "
    "postedAt timestamp, scrapedAt timestamp, createdAt timestamp, updatedAt timestamp"
)
EMPLOYER = "id string, name string, homepage string, careersUrl string, method string, region string, rbq string, scope string, sectors array<string>, verified boolean, enabled boolean"
SCRAPE_RUN = "id bigint, sourceId string, status string, found int, inserted int, updated int, error string, startedAt timestamp, finishedAt timestamp"
JOB_ALERT = (
    "id string, user_id string, label string, query struct<q: string, company: string, regions: array<string>, cities: array<string>, categories: array<string>, employmentTypes: array<string>, "
    "remote: array<string>, sources: array<string>, languages: array<string>, salaryMin: double, postedWithinDays: int>, created_at timestamp, last_notified_at timestamp"
)
FAVORITE = "user_id string, job_id string"
#: What a batch says of each source beside its rows.
BATCH_SIGNALS = "sourceId string, reachable_empty boolean, explicit_empty boolean, force boolean"
