"""Declared schemas of the postings, dictionaries, profiles and reports."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_STRINGS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_POSTING_A = _struct(
    jobPosition=_struct(
        id=_L, url=_S, career=_S, title=_S, address=_S,
        jobCategoryIds=T.ArrayType(_I), technicalTags=T.ArrayType(_struct(name=_S)),
        countryCode=_S, description=_S, requirement=_S, preferredExperience=_S,
        endAt=_S, company=_struct(name=_S),
    )
)

RAW_POSTING_B = _struct(
    job=_struct(
        id=_L,
        detail=_struct(position=_S, main_tasks=_S, requirements=_S, preferred_points=_S),
        address=_struct(location=_S, country_code=_S),
        category_tag=_struct(child_tags=T.ArrayType(_struct(text=_S))),
        skill_tags=T.ArrayType(_struct(text=_S)),
        company=_struct(name=_S),
        annual_from=_I,
    )
)

POSTING = _struct(
    text=_S, id=_L, url=_S, title=_S, location=_S, duty=_S, technicalTags=_S, countryCode=_S,
    description=_S, requirement=_S, preferredExperience=_S, company_name=_S, crawling_dt=_S, career=_I,
)

TECHNICAL_ELEMENT = _struct(category=_S, name=_S, synonym=_S)
TECHNICAL_ELEMENT_LABELED = _struct(seq=_I, category=_S, name=_S, synonym=_S, ner_label=_S)
DUTY_ELEMENT = _struct(name=_S, synonym=_S)

SKILL_PROBABILITY = _struct(
    duty=_S, category=_S, skill=_S, unit=_I, probability=_D, pre_probability=_D,
    description=_S, base_language=_S, use_framework=_S,
)

DUTY_ANALYSIS = _struct(duty=_S, language=_S, career=_S, degree=_S, language_summary=_S)
IMAGE_PATHS = _struct(id=_L, duty_category=_S, image_path=_S)

CUSTOMIZED_ANALYSIS = _struct(
    seq=_L, duty=_S, it_language=_S, framework=_S, library=_S, tool=_S,
    improvement=_S, conclusion=_S, an_dt=_S,
)

PROFILE = _struct(
    profile_id=_L, languages=_STRINGS, frameworks=_STRINGS, libraries=_STRINGS,
    devtools=_STRINGS, jobs=_STRINGS,
)

DUTY_WEIGHTS = _struct(duty=_S, category=_S, weight=_D)
SYNONYM_DOCUMENT = T.MapType(_S, T.MapType(_S, _STRINGS))
TOKEN_TAGS = _struct(index=_L, tokens=_STRINGS, tags=_STRINGS)
