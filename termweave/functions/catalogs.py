"""The catalogues the delivered data draws its codes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAJORS: dict[str, int] = {
    "Computer Science": 120,
    "Biology": 110,
    "Economics": 105,
    "Psychology": 95,
    "Neuroscience": 90,
    "Biochemistry": 70,
    "Health: Science, Society, and Policy": 55,
    "Mathematics": 50,
    "Physics": 45,
    "Chemistry": 45,
    "Politics": 60,
    "International and Global Studies": 65,
    "Sociology": 50,
    "Anthropology": 40,
    "American Studies": 40,
    "English": 45,
    "History": 45,
    "Philosophy": 35,
    "Studio Art": 30,
    "Business": 35,
    "Economics and Business": 30,
    "Applied Mathematics": 30,
    "Environmental Studies": 25,
    "Music": 20,
    "East Asian Studies": 15,
}

# Year of study at admission; a few people have none.
FIRST_YEARS: dict[str | None, int] = {"Freshman": 400, "Sophomore": 284, "Junior": 124, "Senior": 182, None: 11}

SUBJECTS: tuple[str, ...] = (
    "COSI", "BIOL", "ECON", "PSYC", "NEUR", "CHEM", "MATH", "HSSP",
    "AMST", "ENVS", "POL", "ANTH", "ENG", "HIST", "PHIL", "BUS",
)

HOLD_TYPES: tuple[str, ...] = (
    "advising", "financial", "immunization", "conduct", "housing", "workday_verification",
)

SYSTEMS: dict[str, str] = {
    "primary": "Workday Student",
    "registration": "Workday",
    "lms": "Moodle",
}


def majors(spark: SparkSession) -> DataFrame:
    """The majors as a table (major, weight): as long as the catalogue, so safe to broadcast."""
    return spark.createDataFrame(list(MAJORS.items()), "major STRING, weight INT")


def subjects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SUBJECTS], "subject STRING")


def hold_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in HOLD_TYPES], "hold_type STRING")
