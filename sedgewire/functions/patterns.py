"""Pattern tables of behavior hints and effects, tried on every line of a body."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hint type, detail and pattern for TypeScript and JavaScript.
SCRIPT_HINTS = r"""
db_read orm_find \.find(One|Many|All|ById|Unique|First|Where)\s*\(
db_read query_select \.select\s*\(\s*['"`{]
db_read raw_query \.query\s*\(\s*['"`]
db_read db_contextual_read \b(db|model|repo|repository|collection|table|prisma|knex|sequelize|typeorm|pool|client)\.\w*(?:get|find|select|query|count|aggregate)\w*\s*\(
db_write orm_save \.save\s*\(\s*\{
db_write db_insert \.insert(One|Many)?\s*\(
db_write db_update \.update(One|Many|ById|Where)?\s*\(\s*\{
db_write db_delete \.delete(One|Many|ById|Where)\s*\(
db_write db_destroy \.destroy\s*\(
db_write db_contextual_write \b(db|model|repo|repository|collection|table|prisma|knex|sequelize|typeorm|pool|client)\.\w*(?:save|insert|update|delete|remove|create|upsert|destroy)\w*\s*\(
network_call fetch fetch\s*\(
network_call axios axios\.(get|post|put|patch|delete)\s*\(
network_call http_request \.request\s*\(
network_call node_http https?\.\s*(get|request)\s*\(
network_call websocket WebSocket
file_io fs_operation fs\.(read|write|append|unlink|mkdir|rmdir)
file_io read_file readFile(Sync)?\s*\(
file_io write_file writeFile(Sync)?\s*\(
cache_op cache_operation \.cache\.(get|set|del|clear)
cache_op redis redis\.(get|set|hget|hset|del)
auth_check authenticate \.authenticate\s*\(
auth_check authorize \.authorize\s*\(
auth_check token_verify verify(Token|JWT|Session)
auth_check auth_check \.isAuthenticated
validation validate \.validate\s*\(
validation schema_validation Joi\.|Yup\.|Zod\.
throws throws throw\s+new\s+\w+
catches catches catch\s*\(
state_mutation this_assignment this\.\w+\s*=
state_mutation set_state \.setState\s*\(
transaction db_transaction \.transaction\s*\(
transaction sql_transaction BEGIN|COMMIT|ROLLBACK
acquires_lock lock_acquire \.(lock|acquire|tryLock)\s*\(
acquires_lock mutex [Mm]utex
acquires_lock semaphore [Ss]emaphore
acquires_lock synchronized synchronized
serialization json_stringify JSON\.stringify
serialization serialize \.(serialize|marshal)\s*\(
serialization to_json \.toJSON\s*\(
serialization protobuf protobuf
serialization encode \.encode\s*\(
logging console console\.(log|warn|error|info)
logging structured_log log\.(debug|info|warn|error|fatal)
"""
# The same for Python.
PYTHON_HINTS = r"""
db_read query() \.query\s*\(
db_read execute() \.execute\s*\(
db_read fetchone() \.fetchone\s*\(
db_read fetchall() \.fetchall\s*\(
db_read fetchmany() \.fetchmany\s*\(
db_read select() \.select\s*\(
db_read filter() \.filter\s*\(
db_read get() (session|cursor|queryset|objects)\.get\s*\(
db_read all() (\.objects\.all\s*\(|session\.query.*\.all\s*\()
db_read first() (\.objects\.first\s*\(|session\.query.*\.first\s*\(|queryset\.first\s*\()
db_read sqlalchemy_query session\.query\s*\(
db_write insert() \.insert\s*\(
db_write update() \.update\s*\(
db_write delete() \.delete\s*\(
db_write commit() \.commit\s*\(
db_write add() (session\.add\s*\(|\.objects\.add\s*\()
db_write merge() \.merge\s*\(
db_write save() (\.save\s*\(\s*\)|session\.save\s*\()
db_write bulk_create() \.bulk_create\s*\(
db_write bulk_update() \.bulk_update\s*\(
network_call requests requests\.(get|post|put|patch|delete|head|options)\s*\(
network_call urllib urllib\.(request|urlopen)
network_call aiohttp aiohttp\.
network_call httpx httpx\.(get|post|put|patch|delete|head|options|AsyncClient|Client)
network_call socket socket\.
network_call grpc grpc\.
network_call fetch \.fetch\s*\(
file_io open() \bopen\s*\(
file_io pathlib Path\.(read_text|read_bytes|write_text|write_bytes)\s*\(
file_io file_method \.(read|write|readline|readlines|writelines)\s*\(
file_io os.path os\.path\.
file_io os_fs os\.(remove|rename|makedirs|mkdir|rmdir|listdir|walk)\s*\(
file_io shutil shutil\.
file_io tempfile tempfile\.
file_io pickle pickle\.(dump|load)\s*\(
file_io json_io json\.(dump|load)\s*\(
cache_op cache_operation cache\.(get|set|delete|clear|invalidate)\s*\(
cache_op redis redis\.(get|set|hget|hset|del|setex|expire)\s*\(
cache_op lru_cache @lru_cache
auth_check login_required @login_required
auth_check check_permission check_permission\s*\(
auth_check authenticate authenticate\s*\(
auth_check verify_token verify_token\s*\(
validation pydantic pydantic\.
validation validate() \.validate\s*\(
validation schema Schema\s*\(
throws raise \braise\s+\w+
catches except \bexcept\s+
catches bare_except \bexcept\s*:
state_mutation self_assignment self\.\w+\s*=
state_mutation setattr \bsetattr\s*\(
state_mutation global_mutation \bglobal\s+\w+
state_mutation nonlocal_mutation \bnonlocal\s+\w+
state_mutation inplace_operation \w+_\s*\(
transaction atomic_decorator @atomic
transaction begin() \.begin\s*\(
transaction transaction_context with\s+transaction
transaction rollback() \.rollback\s*\(
transaction sql_transaction BEGIN|COMMIT|ROLLBACK
logging logging logging\.(debug|info|warning|error|critical|exception)\s*\(
logging logger logger\.(debug|info|warning|error|critical|exception)\s*\(
logging log log\.(debug|info|warning|error|critical|exception)\s*\(
logging print \bprint\s*\(
"""
# The same for the other languages, then those of Java and of Go alone.
OTHER_HINTS = r"""
db_read orm_find \.(findOne|findMany|findAll|findById|findUnique|findFirst)\s*\(
db_read query_select \.select\s*\(
db_read raw_query \.query\s*\(
db_read db_get \.(getOne|getMany|getAll|getById)\s*\(
db_write orm_save \.(persist|saveAll|saveMany)\s*\(
db_write db_insert \.(insertOne|insertMany|bulkInsert|batchInsert)\s*\(
db_write db_update \.(updateOne|updateMany|updateById|bulkUpdate)\s*\(
db_write db_delete \.(deleteOne|deleteMany|deleteById|bulkDelete)\s*\(
network_call fetch fetch\s*\(
network_call http_request \.request\s*\(
network_call node_http https?\.\s*(get|request)\s*\(
network_call websocket WebSocket
cache_op cache_operation \.cache\.(get|set|del|clear)
cache_op redis redis\.(get|set|hget|hset|del)
auth_check authenticate \.authenticate\s*\(
auth_check token_verify verify(Token|JWT|Session)
validation validate \.validate\s*\(
throws throws throw\s+new\s+\w+
throws python_raise raise\s+\w+
catches catches catch\s*\(
catches python_except except\s+
state_mutation this_assignment this\.\w+\s*=
state_mutation self_assignment self\.\w+\s*=
transaction db_transaction \.transaction\s*\(
transaction sql_transaction BEGIN|COMMIT|ROLLBACK
logging structured_log log\.(debug|info|warn|error|fatal)
logging go_fmt fmt\.(Print|Println|Printf|Errorf)
"""
JAVA_HINTS = r"""
db_read jdbc jdbc|DriverManager\.getConnection
db_read jpa EntityManager|@PersistenceContext
db_read hibernate Hibernate|SessionFactory|Session\.
network_call java_httpclient HttpClient\.new
network_call okhttp OkHttpClient|okhttp3
network_call spring_http RestTemplate|WebClient
file_io java_nio_files Files\.(read|write|copy|move|delete|create)
file_io java_file_io FileInputStream|FileOutputStream|FileReader|FileWriter
transaction spring_transactional @Transactional
acquires_lock java_synchronized synchronized\s*\(
acquires_lock java_lock ReentrantLock|\.lock\s*\(
logging java_LOG LOG\.(debug|info|warn|error|trace)
throws java_throw throw\s+new\s+
"""
GO_HINTS = r"""
concurrency goroutine go\s+func
concurrency go_channel_create make\s*\(\s*chan\s
concurrency go_channel_recv <-\s*\w+
network_call go_http http\.(Get|Post|Head|NewRequest)
db_read go_sql_open sql\.Open
file_io go_os_file os\.(Open|Create|ReadFile|WriteFile)
acquires_lock go_sync sync\.(Mutex|RWMutex|WaitGroup)
"""
# Effect kind, descriptor and pattern, for all languages, then for one alone.
EFFECTS = r"""
reads db.query (?i)\.(find|findOne|findMany|findById|select|get|query|count|aggregate)\b
writes db.write (?i)\.(save|insert|create|upsert|bulkCreate|insertMany)\b
writes db.update (?i)\.(update|updateOne|updateMany|increment|decrement)\b
writes db.delete (?i)\.(delete|destroy|remove|deleteOne|deleteMany|truncate)\b
writes db.transaction (?i)\.(transaction|beginTransaction|startTransaction)\b
acquires_lock db.transaction_lock (?i)\.(transaction|beginTransaction|startTransaction)\b
calls_external network.http (?i)\b(fetch|axios|got|superagent|request)\b
calls_external network.http (?i)\b(axios|http|https|fetch|got|superagent|request|client|api|restClient|httpClient)\.(get|post|put|patch|delete)\s*\(
emits event.generic (?i)\.(emit|publish|dispatch|send|broadcast|trigger)\b
emits event.messaging (?i)\b(EventEmitter|PubSub|MessageQueue|kafka|rabbitmq|sns|sqs)\b
reads file.read (?i)\bfs\.(readFile|readFileSync|readdir|readdirSync|stat|statSync|access)\b
writes file.write (?i)\bfs\.(writeFile|writeFileSync|appendFile|mkdir|mkdirSync|unlink|rename|copyFile)\b
opens file.path (?i)\bfs\.(writeFile|writeFileSync|appendFile|mkdir|mkdirSync|unlink|rename|copyFile)\b
opens file.stream.read (?i)\bcreateReadStream\b
opens file.stream.write (?i)\bcreateWriteStream\b
writes file.stream (?i)\bcreateWriteStream\b
reads cache.redis.read (?i)\bredis\.(get|mget|hget|hgetall|lrange|smembers)\b
writes cache.redis.write (?i)\bredis\.(set|mset|hset|lpush|rpush|sadd|del|expire|incr|decr)\b
logs log.generic (?i)\b(console|logger|log)\.(log|info|warn|error|debug|trace|fatal)\b
requires auth.check (?i)\b(authenticate|authorize|verifyToken|checkPermission|requireRole|guardRoute)\b
requires auth.token (?i)\b(jwt|passport|session)\.(verify|sign|authenticate|decode)\b
acquires_lock concurrency.lock (?i)\b(mutex|semaphore|lock|acquire|acquireLock)\b
normalizes data.normalize (?i)\b(validate|sanitize|normalize|trim|toLowerCase|toUpperCase|slugify)\b
calls_external network.stripe (?i)\bstripe\b
calls_external network.email_sms (?i)\b(twilio|sendgrid|mailgun|ses)\b
calls_external network.cloud_storage (?i)\b(s3|gcs|azure\.storage|cloudStorage)\b
"""
PYTHON_EFFECTS = r"""
calls_external network.http (?i)\b(requests)\.(get|post|put|patch|delete|head|options)\s*\(
"""
JAVA_EFFECTS = r"""
calls_external network.http (?i)\b(HttpClient|RestTemplate|OkHttpClient|WebClient)\.(get|post|put|patch|delete)\s*\(
reads db.jdbc_read \b(JdbcTemplate|NamedParameterJdbcTemplate)\.(query|queryForObject|queryForList)\b
writes db.jdbc_write \b(JdbcTemplate|NamedParameterJdbcTemplate)\.(update|batchUpdate|execute)\b
reads db.jpa_read \bEntityManager\.(find|createQuery|createNamedQuery|getReference)\b
writes db.jpa_write \bEntityManager\.(persist|merge|remove|flush)\b
calls_external network.java_http \b(HttpClient|OkHttpClient|RestTemplate|WebClient)\b
opens file.java_nio \bFiles\.(read|write|copy|move|delete|walk|list|newInputStream|newOutputStream)\b
opens file.java_io \b(FileInputStream|FileOutputStream|BufferedReader|BufferedWriter)\b
acquires_lock concurrency.java_synchronized \bsynchronized\b
acquires_lock concurrency.java_lock \b(ReentrantLock|StampedLock|CountDownLatch|Semaphore)\b
writes db.transaction \b@Transactional\b
acquires_lock db.transaction_lock \b@Transactional\b
logs log.java_logger \bLogger\.(info|warn|error|debug|trace)\b
"""
GO_EFFECTS = r"""
calls_external network.go_http \bhttp\.(Get|Post|Head|NewRequest)\b
reads db.go_sql \bsql\.(Open|DB)\b
opens file.go_os \bos\.(Open|Create|Remove|Mkdir)\b
acquires_lock concurrency.go_sync \bsync\.(Mutex|RWMutex|WaitGroup)\b
calls_external runtime.goroutine \bgo\s+\w+\(
logs log.go \b(log|slog)\.(Print|Fatal|Panic|Info|Warn|Error|Debug)\b
"""
RUST_EFFECTS = r"""
calls_external network.http (?i)\breqwest::Client\b.*\.(get|post|put|patch|delete)\s*\(
calls_external runtime.tokio \btokio::(spawn|block_on|select!)\b
calls_external network.reqwest \breqwest::(get|Client)\b
opens file.rust_fs \bstd::fs::
opens file.rust_file \bFile::(open|create)\b
reads db.rust_orm_read (?i)\b(diesel|sqlx|sea_orm)::.*(select|find|load|get)\b
writes db.rust_orm_write (?i)\b(diesel|sqlx|sea_orm)::.*(insert|update|delete|execute)\b
mutates state.arc_shared \bArc::(new|clone)\b
acquires_lock concurrency.mutex \bMutex::(new|lock)\b
acquires_lock concurrency.rwlock \bRwLock::(new|read|write)\b
mutates state.unsafe_block \bunsafe\s*\{
throws error.panic \bpanic!\b
throws error.unwrap_panic \b\.unwrap\(\)
normalizes data.serde \bserde(_json)?::(to_string|from_str|serialize|deserialize)\b
logs log.tracing \btracing::(info|warn|error|debug|trace)!?\b
logs log.rust_log \blog::(info|warn|error|debug|trace)!?\b
"""
CSHARP_EFFECTS = r"""
calls_external network.http (?i)\b(HttpClient|RestTemplate|OkHttpClient|WebClient)\.(get|post|put|patch|delete)\s*\(
reads db.ef_context \bDbContext\b
reads db.ef_read \b(DbSet|IQueryable)\.(Where|Select|Include|FirstOrDefault|ToList|Any|Count)\b
writes db.ef_write \b(SaveChanges|SaveChangesAsync|Add|Remove|Update)\b
calls_external network.csharp_http \bHttpClient\.(GetAsync|PostAsync|PutAsync|DeleteAsync|SendAsync)\b
opens file.csharp_io \b(File|Directory)\.(Read|Write|Create|Delete|Move|Copy|Exists)\b
acquires_lock concurrency.csharp_lock \block\s*\(
acquires_lock concurrency.csharp_sync \b(SemaphoreSlim|Monitor|Mutex)\b
logs log.csharp_ilogger (?i)\bILogger\.(Log|Info|Warn|Error|Debug|Trace)\b
"""
KOTLIN_EFFECTS = r"""
calls_external network.http (?i)\b(HttpClient|RestTemplate|OkHttpClient|WebClient)\.(get|post|put|patch|delete)\s*\(
"""
RUBY_EFFECTS = r"""
reads db.activerecord \b(ActiveRecord|ApplicationRecord)
reads db.ar_read \.(where|find|find_by|pluck|select|joins|includes|eager_load)\b
writes db.ar_write \.(create|update|destroy|save|delete|insert)\b
calls_external network.ruby_http \b(Net::HTTP|HTTParty|Faraday|RestClient)\b
opens file.ruby_io \bFile\.(open|read|write|delete)\b
reads cache.rails \bRails\.cache\b
reads cache.redis \bRedis\b
throws error.ruby_raise \braise\s+\w
logs log.rails \bRails\.logger\b
"""
CPP_EFFECTS = r"""
calls_external runtime.cpp_thread \bstd::thread\b
acquires_lock concurrency.cpp_mutex \bstd::(mutex|shared_mutex|lock_guard|unique_lock)\b
opens file.cpp_fstream \bstd::(ifstream|ofstream|fstream)\b
calls_external network.boost_asio \bboost::asio\b
logs log.cpp_cout \bstd::cout\b
logs log.cpp_cerr \bstd::cerr\b
"""

# Invariants of bodies by family: category, strength, pattern ## what it states (\1 to \9: the pattern's groups).
ASSERTIONS = r"""
assert 0.90 \bassert\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))+)\) ## assert:\1
assert 0.85 \bconsole\s*\.\s*assert\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))+)\) ## console_assert:\1
assert 0.92 \binvariant\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))+)\) ## invariant_call:\1
precondition 0.93 \bprecondition\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))+)\) ## precondition:\1
"""
GUARDS = r"""
guard_clause 0.88 if\s*\(\s*(![\w.\[\]?]+|[\w.\[\]?]+\s*(?:===?|!==?)\s*(?:null|undefined|false|0|''|""|``))\s*\)\s*\{?\s*throw\b ## guard_clause:\1 => throw
guard_clause 0.75 if\s*\(\s*(![\w.\[\]?]+|[\w.\[\]?]+\s*(?:===?|!==?)\s*(?:null|undefined|false|0|''|""|``))\s*\)\s*\{?\s*return\b ## guard_clause:\1 => early_return
"""
TYPE_GUARDS = r"""
type_guard 0.82 typeof\s+([\w.]+)\s*(?:===?|!==?)\s*['"](string|number|boolean|function|object|undefined|bigint|symbol)['"] ## type_guard:typeof \1 === '\2'
type_guard 0.82 ([\w.]+)\s+instanceof\s+([\w.]+) ## type_guard:\1 instanceof \2
type_guard 0.82 Array\s*\.\s*isArray\s*\(\s*([\w.]+)\s*\) ## type_guard:Array.isArray(\1)
type_guard 0.78 (?:Number\s*\.\s*)?isNaN\s*\(\s*([\w.]+)\s*\) ## type_guard:isNaN(\1) checked
type_guard 0.78 (?:Number\s*\.\s*)?isFinite\s*\(\s*([\w.]+)\s*\) ## type_guard:isFinite(\1) checked
"""
NULL_CHECKS = r"""
null_safety 0.72 ([\w.]+)\s*\?\?\s*([^;,\n]+) ## null_safety:\1 has nullish fallback \2
null_safety 0.68 ([\w.]+)\s*\?\.\s*([\w.]+) ## null_safety:\1 optional-chained to \2
null_check 0.80 if\s*\(\s*([\w.]+)\s*(?:!==?|===?)\s*(?:null|undefined)\s*\) ## null_check:\1 explicitly checked against null/undefined
null_check 0.80 if\s*\(\s*([\w.]+)\s*(?:!=)\s*(?:null)\s*\) ## null_check:\1 loosely checked (covers null + undefined)
"""
RANGES = r"""
range_check 0.88 Math\s*\.\s*max\s*\(\s*(-?\d+(?:\.\d+)?)\s*,\s*Math\s*\.\s*min\s*\(\s*(-?\d+(?:\.\d+)?)\s*,\s*([\w.]+)\s*\)\s*\) ## range_clamp:\3 clamped to [\1, \2]
range_check 0.83 Math\s*\.\s*max\s*\(\s*(-?\d+(?:\.\d+)?)\s*,\s*([\w.]+)\s*\) ## range_lower_bound:\2 >= \1 (clamped)
range_check 0.83 Math\s*\.\s*min\s*\(\s*(-?\d+(?:\.\d+)?)\s*,\s*([\w.]+)\s*\) ## range_upper_bound:\2 <= \1 (clamped)
range_check 0.78 if\s*\(\s*([\w.]+)\s*(<|>|<=|>=)\s*(-?\d+(?:\.\d+)?)\s*\) ## boundary_check:\1 \2 \3
length_check 0.80 if\s*\(\s*([\w.]+)\s*\.\s*length\s*(<|>|<=|>=|===?|!==?)\s*(\d+)\s*\) ## length_check:\1.length \2 \3
"""
ENUMS = r"""
enum_restriction 0.82 \[\s*([^\]]+)\s*\]\s*\.\s*includes\s*\(\s*([\w.]+)\s*\) ## enum_restriction:\2 in [\1]
"""
NORMALIZATIONS = r"""
normalization_trim 0.70 ([\w.]+)\s*\.\s*trim\s*\(\s*\) ## normalization:\1 is trimmed
normalization_lowercase 0.70 ([\w.]+)\s*\.\s*toLowerCase\s*\(\s*\) ## normalization:\1 is lowercased
normalization_uppercase 0.70 ([\w.]+)\s*\.\s*toUpperCase\s*\(\s*\) ## normalization:\1 is uppercased
normalization_replace 0.68 ([\w.]+)\s*\.\s*replace\s*\(\s*(\/(?:[^/\\]|\\.)+\/[gimsuy]*|['"][^'"]*['"])\s*, ## normalization:\1 undergoes replace(\2)
normalization_parse 0.72 parseInt\s*\(\s*([\w.]+)\s*(?:,\s*\d+)?\s*\) ## normalization:\1 parsed as integer
normalization_parse 0.72 parseFloat\s*\(\s*([\w.]+)\s*\) ## normalization:\1 parsed as float
normalization_parse 0.72 Number\s*\(\s*([\w.]+)\s*\) ## normalization:\1 coerced to Number
deserialization 0.75 JSON\s*\.\s*parse\s*\(\s*([\w.]+)\s*\) ## deserialization:\1 is JSON-parsed (may throw SyntaxError)
"""
DECORATORS = r"""
decorator_email 0.92 (?i)@IsEmail\s*\( ## decorator_validation:field must be valid email
decorator_url 0.92 (?i)@IsUrl\s*\( ## decorator_validation:field must be valid URL
decorator_uuid 0.92 (?i)@IsUUID\s*\( ## decorator_validation:field must be valid UUID
decorator_int 0.90 (?i)@IsInt\s*\( ## decorator_validation:field must be integer
decorator_number 0.90 (?i)@IsNumber\s*\( ## decorator_validation:field must be number
decorator_string 0.90 (?i)@IsString\s*\( ## decorator_validation:field must be string
decorator_boolean 0.90 (?i)@IsBoolean\s*\( ## decorator_validation:field must be boolean
decorator_date 0.90 (?i)@IsDate\s*\( ## decorator_validation:field must be Date
decorator_enum 0.90 (?i)@IsEnum\s*\( ## decorator_validation:field must be enum value
decorator_not_empty 0.90 (?i)@IsNotEmpty\s*\( ## decorator_validation:field must not be empty
decorator_optional 0.80 (?i)@IsOptional\s*\( ## decorator_validation:field is optional
decorator_array 0.90 (?i)@IsArray\s*\( ## decorator_validation:field must be array
decorator_range 0.90 (?i)@Min\s*\(\s*(-?\d+(?:\.\d+)?)\s*\) ## decorator_range:min=\1
decorator_range 0.90 (?i)@Max\s*\(\s*(-?\d+(?:\.\d+)?)\s*\) ## decorator_range:max=\1
decorator_length 0.90 (?i)@MinLength\s*\(\s*(\d+)\s*\) ## decorator_length:minLength=\1
decorator_length 0.90 (?i)@MaxLength\s*\(\s*(\d+)\s*\) ## decorator_length:maxLength=\1
decorator_length 0.90 (?i)@Length\s*\(\s*(\d+)\s*\) ## decorator_length:length=[\1]
decorator_length 0.90 (?i)@Length\s*\(\s*(\d+)\s*,\s*(\d+)\s*\) ## decorator_length:length=[\1, \2]
decorator_pattern 0.88 (?i)@Matches\s*\(\s*(\/(?:[^/\\]|\\.)+\/[gimsuy]*)\s*\) ## decorator_pattern:must match \1
decorator_auth 0.93 (?i)@(?:RequiresRole|Roles?|HasRole)\s*\(\s*['"]([^'"]+)['"]\s*\) ## decorator_auth:requires role '\1'
decorator_auth 0.93 (?i)@(?:Authenticated|UseGuards|Auth|RequireAuth)\s*\( ## decorator_auth:requires authentication
decorator_rate_limit 0.88 (?i)@(?:RateLimit|Throttle|RateLimiter)\s*\(\s*(\d+)\s*\) ## decorator_rate_limit:limit=\1
decorator_rate_limit 0.88 (?i)@(?:RateLimit|Throttle|RateLimiter)\s*\(\s*(\d+)\s*,\s*['"]([^'"]+)['"]\s*\) ## decorator_rate_limit:limit=\1 per \2
decorator_validate 0.85 (?i)@(?:Validate|ValidateNested|ValidateIf)\s*\( ## decorator_validation:input undergoes validation
"""


def rows(text: str) -> list[tuple[str, str, str]]:
    """(kind, name, pattern) of each line of a table."""
    return [tuple(line.split(" ", 2)) for line in text.strip().split("\n") if line]


#: Tables by language; "" for all that are not named.
HINTS = {"typescript": rows(SCRIPT_HINTS), "javascript": rows(SCRIPT_HINTS), "python": rows(PYTHON_HINTS), "java": rows(OTHER_HINTS) + rows(JAVA_HINTS), "go": rows(OTHER_HINTS) + rows(GO_HINTS), "": rows(OTHER_HINTS)}
_OWN_EFFECTS = {"python": PYTHON_EFFECTS, "java": JAVA_EFFECTS, "go": GO_EFFECTS, "rust": RUST_EFFECTS, "csharp": CSHARP_EFFECTS, "kotlin": KOTLIN_EFFECTS, "ruby": RUBY_EFFECTS, "cpp": CPP_EFFECTS, "": ""}
EFFECT_PATTERNS = {language: rows(EFFECTS + own) for language, own in _OWN_EFFECTS.items()}


def matches(text: Column, language: Column, tables: dict[str, list[tuple[str, str, str]]]) -> Column:
    """array<struct<kind, name>> of the patterns of the language's table that are found in a text."""
    found = lambda t: F.filter(F.array(*[F.when(text.rlike(rx), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"))) for k, n, rx in t]), lambda x: x.isNotNull())
    out = None
    for name, t in tables.items():
        if name:
            out = F.when(language == name, found(t)) if out is None else out.when(language == name, found(t))
    return out.otherwise(found(tables[""]))


def matches_sql(text: str, language: str, tables: dict[str, list[tuple[str, str, str]]]) -> str:
    """The same as a DuckDB list of 'kind|name'."""
    quote = lambda s: s.replace("'", "''")
    found = lambda t: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{quote(rx)}') THEN '{k}|{n}' END" for k, n, rx in t) + "], lambda x: x IS NOT NULL)"
    return f"CASE {language} " + " ".join(f"WHEN '{n}' THEN {found(t)}" for n, t in tables.items() if n) + f" ELSE {found(tables[''])} END"


def invariant_rules(text: str) -> list[tuple[str, float, str, str]]:
    """(category, strength, pattern, statement) of each line of a table of invariants."""
    split = [line.split(" ", 2) for line in text.strip().split("\n")]
    return [(category, float(strength), *rest.split(" ## ")) for category, strength, rest in split]


INVARIANTS = {name: invariant_rules(text) for name, text in (("assertions", ASSERTIONS), ("guards", GUARDS), ("type_guards", TYPE_GUARDS), ("null_checks", NULL_CHECKS), ("ranges", RANGES), ("enums", ENUMS), ("normalizations", NORMALIZATIONS), ("decorators", DECORATORS))}


def invariants(text: Column, rules: list[tuple[str, float, str, str]]) -> Column:
    """array<struct<category, expression, strength>> of all matches in a text, with runs of white space as one blank."""
    def found(category: str, strength: float, rx: str, states: str) -> Column:
        filled = lambda m: F.trim(F.regexp_replace(F.regexp_replace(m, F.lit(rx), F.lit(re.sub(r"\\(\d)", r"$\1", states))), r"[ \t\r\n]+", " "))
        return F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), lambda m: F.struct(F.lit(category).alias("category"), filled(m).alias("expression"), F.lit(strength).alias("strength")))

    return F.flatten(F.array(*[found(*rule) for rule in rules]))


def invariants_sql(text: str, rules: list[tuple[str, float, str, str]]) -> str:
    """The same as a DuckDB list of structs."""
    quote = lambda s: s.replace("'", "''")
    found = lambda c, w, rx, states: f"list_transform(regexp_extract_all({text}, '{quote(rx)}'), lambda m: {{'category': '{c}', 'expression': trim(regexp_replace(regexp_replace(m, '{quote(rx)}', '{quote(states)}'), '[ \\t\\r\\n]+', ' ', 'g')), 'strength': {w}::DOUBLE}})"
    return "flatten([" + ", ".join(found(*rule) for rule in rules) + "])"
