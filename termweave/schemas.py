"""Schemas of the campus extracts, in file order.

The names and types are fixed values: they are the format of the delivered files.
"""

from __future__ import annotations

from pyspark.sql import types as T

EXTRACTS_DDL: dict[str, str] = {
    "students_master": """
        student_id STRING, full_name STRING, email STRING, birth_date DATE,
        admit_term STRING, initial_major STRING, initial_year STRING,
        primary_system STRING""",
    "identity_crosswalk": """
        student_id STRING, moodle_user_key STRING, workday_person_id STRING""",
    "sis_enrollments": """
        student_id STRING, term_code STRING, class_level STRING, major STRING,
        credits_attempted INT, credits_earned INT, term_gpa DOUBLE,
        cumulative_gpa DOUBLE, cumulative_credits INT, enrollment_status STRING,
        registration_system STRING""",
    "registrar_course_enrollments": """
        student_id STRING, term_code STRING, workday_course_section_id STRING,
        subject STRING, catalog_number STRING, credits INT, grading_basis STRING,
        letter_grade STRING, grade_points DOUBLE""",
    "lms_activity": """
        moodle_user_key STRING, term_code STRING, course_shells INT, login_count INT,
        page_views INT, assignments_submitted INT, forum_posts INT, quiz_attempts INT,
        last_activity_date DATE, lms_platform STRING""",
    "financial_aid": """
        workday_person_id STRING, term_code STRING, fafsa_received BOOLEAN,
        pell_amount INT, institutional_grant INT, loans INT, balance_due INT""",
    "advising_holds": """
        hold_id STRING, term_code STRING, student_id STRING, hold_type STRING,
        active BOOLEAN, placed_date DATE, cleared_date DATE""",
    "metadata": """
        institution STRING, seed BIGINT, start_term STRING, students BIGINT,
        systems STRUCT<lms: STRING, registration: STRING>, terms ARRAY<STRING>""",
    "receipts": """
        query_name STRING, frag_level STRING, timestamp TIMESTAMP, source_fanout INT,
        runtime_ms DOUBLE, row_count BIGINT, receipt STRING""",
}


def schema(table: str) -> T.StructType:
    """Schema of one delivered table."""
    return T.StructType.fromDDL(EXTRACTS_DDL[table])


def known(table: str) -> bool:
    return table in EXTRACTS_DDL
