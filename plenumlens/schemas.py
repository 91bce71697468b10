"""Schemas of landed files and results, as DDL strings."""

#: A statement as it is read: every field as text (an object as its JSON), so that one of
#: another type than usual spoils neither its statement nor its file.
LANDED_STATEMENT = "struct<num:string,id:string,statement_id:string,name:string,speaker:string,text:string,segment:string>"

#: One schema for every envelope of a transcript file, including a bare list of statements.
TRANSCRIPT_FILE = (
    "metadata struct<term:string,proceeding_id:string,date:string>, "
    f"statements array<{LANDED_STATEMENT}>, data struct<statements:array<{LANDED_STATEMENT}>>, "
    "num string, id string, statement_id string, name string, text string, segment string, speaker string, "
    "_corrupt_record string"
)

MEMBER_FIELDS = (
    "id int, firstName string, lastName string, club string, districtName string, districtNum int, "
    "educationLevel string, numberOfVotes int, profession string, voivodeship string, email string"
)
MEMBER_FILE = (
    f"metadata struct<generated_at:string>, data array<struct<{MEMBER_FIELDS.replace(' int', ':int').replace(' string', ':string')}>>, "
    f"{MEMBER_FIELDS}, _corrupt_record string"
)

PROCEEDING_STRUCT = "struct<number:int,title:string,dates:array<string>,current:boolean>"
PROCEEDING_FILE = (
    f"metadata struct<generated_at:string>, data {PROCEEDING_STRUCT}, proceeding_data {PROCEEDING_STRUCT}, "
    "number int, title string, dates array<string>, current boolean, _corrupt_record string"
)

VERDICT = "is_funny boolean, confidence double, reason string, api_used string"
FRAGMENT = (
    "struct<statement_id:bigint,start_offset:int,end_offset:int,text:string,score:double,"
    "matched_keywords:array<struct<keyword:string,count:int,weight:double>>,"
    "ai_evaluation:struct<is_funny:boolean,confidence:double,reason:string,api_used:string,cached:boolean>>"
)
RESULT_BODY = (
    f"source_file string, n_statements bigint, n_processed bigint, n_fragments bigint, fragments array<{FRAGMENT}>"
)
RESULT_FILE = (
    "metadata struct<generated_at:string,scraper_version:string>, "
    f"data struct<source_file:string,n_statements:bigint,n_processed:bigint,n_fragments:bigint,fragments:array<{FRAGMENT}>>, "
    f"{RESULT_BODY}, _corrupt_record string"
)
