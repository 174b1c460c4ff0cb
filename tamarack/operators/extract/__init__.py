"""Payloads and pages to raw postings. Input: rows of (source_id, company, …, payload); output: columns of model.RAW_JOB that the payload has."""
