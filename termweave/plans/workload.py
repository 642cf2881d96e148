"""An example workload over the campus tables, as SQL: one, three and three tables."""

from __future__ import annotations

WORKLOAD: dict[str, str] = {
    "status_counts": """
        SELECT enrollment_status, term_code, count(DISTINCT student_id) AS people, avg(term_gpa) AS mean_gpa
        FROM sis_enrollments
        GROUP BY enrollment_status, term_code
    """,
    "person_activity": """
        WITH busy AS (
            SELECT moodle_user_key, term_code, count(*) AS visits, sum(login_count) AS logins
            FROM lms_activity
            GROUP BY moodle_user_key, term_code
        )
        SELECT s.student_id, count(*) AS terms, sum(b.visits) AS visits, sum(b.logins) / sum(b.visits) AS mean_logins
        FROM sis_enrollments s
        JOIN identity_crosswalk i ON i.student_id = s.student_id
        JOIN busy b ON b.moodle_user_key = i.moodle_user_key AND b.term_code = s.term_code
        WHERE s.enrollment_status = 'enrolled'
        GROUP BY s.student_id
    """,
    "aid_and_grades": """
        SELECT s.term_code, count(*) AS enrolments, count(f.loans) AS with_aid, sum(f.loans) AS loans,
               avg(CASE WHEN f.loans IS NOT NULL THEN s.term_gpa END) AS mean_gpa_with_aid
        FROM sis_enrollments s
        JOIN identity_crosswalk i ON i.student_id = s.student_id
        LEFT JOIN (
            SELECT workday_person_id, term_code, sum(loans) AS loans
            FROM financial_aid
            GROUP BY workday_person_id, term_code
        ) f ON f.workday_person_id = i.workday_person_id AND f.term_code = s.term_code
        GROUP BY s.term_code
    """,
}
