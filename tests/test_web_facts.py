"""Routes, remote calls, stored queries and annotations: one text per language."""

from skein.sources.web_facts import file_web_facts, web_facts

JAVA = '''@RestController
@RequestMapping({"/api", "/v2"})
class UserController {
  @Autowired private RestTemplate restTemplate;
  @GrpcClient("users") UserServiceGrpc.UserServiceBlockingStub stub;
  @GetMapping("/users/{id}")
  public User get(@PathVariable Long id) { return restTemplate.getForObject("http://user-service/u/" + id, User.class); }
  @RequestMapping(value = "/x", method = {RequestMethod.PUT, RequestMethod.POST})
  void x() { String sql = "SELECT a FROM t"; if (deep) { sql += " WHERE b = 1"; } run(sql); UserGrpc.UserBlockingStub s = UserGrpc.newBlockingStub(ch); s.GetUser(r); }
}
@FeignClient(name = "orders", path = "/o")
interface Orders { @PostMapping("/new") Order make(Order o); @Query("select o from Order o") List<Order> all(); }
'''
GO = '''package p
func main() {
	r := gin.Default()
	api := r.Group("/api")
	v1 := api.Group("/v1")
	v1.GET("/users/:id", auth, h.GetUser)
	pb.RegisterUserServiceServer(s, srv)
	c := pb.NewOrderServiceClient(conn)
	c.PlaceOrder(ctx, req)
	http.Get("http://svc/x")
	http.NewRequest("PUT", "http://svc/y", nil)
	db.Where("a = ?", 1)
	db.Raw("select * from users join teams on 1=1")
}
'''
PY = '''@app.route("/a/<int:id>")
def a(id):
    sql = "select x from t"
    if id:
        sql += " where id = 1"
    cursor.execute(sql)
    session.query(User)
    return requests.post("http://svc/p", json={})

@router.get("/b")
async def b(): ...

@cli.command("sync")
def sync(): ...

@mcp.tool()
def lookup(q): ...

urlpatterns = [path("c/", views.c)]
stub = pb.UserServiceStub(ch)
stub.GetUser(r)
'''
TS = '''@Controller('cats')
export class Cats {
  @Get(':id')
  async one(@Param('id') id: string) { return fetch(`/x/${id}`, { method: 'PATCH' }); }
  @Query(() => Cat) cat() { return this.catRepository.findOne(1); }
}
app.get('/plain', auth, handler);
router.route('/r').get(list).post((q, s) => {});
program.command('build <dir>');
axios.post('http://svc/z');
const client = new UserServiceClient('x'); client.GetUser(q);
const q = "DELETE FROM `t` WHERE a";
'''


def of(language, text, fact):
    return [r[2:] for r in file_web_facts(language, text) if r[0] == fact]


def test_java():
    routes = {(r[0], r[1], r[2], r[3]) for r in of("java", JAVA, "route")}
    assert routes == {
        *[("UserController.get", f"{p}/users/{{id}}", "GET", "spring") for p in ("/api", "/v2")], *[("UserController.x", f"{p}/x", m, "spring") for p in ("/api", "/v2") for m in ("PUT", "POST")], ("Orders.make", "/o/new", "POST", "feign"),
    }
    assert {(r[1], r[2], r[3]) for r in of("java", JAVA, "remote")} == {("http://user-service/u/?", "GET", "http"), ("/o/new", "POST", "feign"), ("users", "", "grpc"), ("User/getUser", "", "grpc")}
    assert ("sql", "SELECT a FROM t WHERE b = 1", "SELECT", "t", "deep:  WHERE b = 1") in of("java", JAVA, "query") and ("Orders.all", "select o from Order o", "SELECT", "Order", "") in of("java", JAVA, "query")
    owners = {(r[0], r[1], r[2]) for r in of("java", JAVA, "annotation")}
    assert {("RestController", "UserController", "class"), ("Autowired", "restTemplate", "field"), ("GetMapping", "UserController.get", "method"), ("FeignClient", "Orders", "class")} <= owners


def test_go():
    assert {r[:4] for r in of("go", GO, "route")} == {("h.GetUser", "/api/v1/users/:id", "GET", "gin"), ("", "UserService", "", "grpc")}
    assert {r[1:4] for r in of("go", GO, "remote")} == {("OrderService/placeOrder", "", "grpc"), ("http://svc/x", "GET", "http"), ("http://svc/y", "PUT", "http")}
    assert {(r[1], r[2], r[3]) for r in of("go", GO, "query")} >= {("db.Where(...)", "SELECT", ""), ("select * from users join teams on 1=1", "SELECT", "users,teams")}


def test_python():
    assert {r[:4] for r in of("python", PY, "route")} == {("a", "/a/<int:id>", "GET", "flask"), ("b", "/b", "GET", "fastapi"), ("sync", "sync", "CLI", "click"), ("lookup", "lookup", "TOOL", "mcp"), ("views.c", "/c/", "GET", "django")}
    assert {r[1:4] for r in of("python", PY, "remote")} == {("http://svc/p", "POST", "http"), ("UserService/getUser", "", "grpc")}
    queries = of("python", PY, "query")
    assert ("sql", "select x from t where id = 1", "SELECT", "t", "id:  where id = 1") in queries and ("session", "session.query(...)", "SELECT", "", "") in queries


def test_typescript():
    assert {r[:4] for r in of("typescript", TS, "route")} == {("Cats.one", "/cats/:id", "GET", "nestjs"), ("Cats.cat", "cat", "Query", "graphql"), ("handler", "/plain", "GET", "express"), ("list", "/r", "GET", "express"), ("lambda", "/r", "POST", "express"), ("", "build", "CLI", "commander")}
    assert {r[1:4] for r in of("typescript", TS, "remote")} == {("/x/${id}", "PATCH", "http"), ("http://svc/z", "POST", "http"), ("UserService/getUser", "", "grpc")}
    assert {r[1:4] for r in of("typescript", TS, "query")} == {("this.catRepository.findOne(...)", "SELECT", ""), ("DELETE FROM `t` WHERE a", "DELETE", "t")}


def test_expressions():
    java = '''@Data class P { private boolean ok; private List<String> names; int f(Color c) {
    switch (c) { case RED: case Color.BLUE: return 1; default: }
    var a = b; var d = this.e; var g = h(); var k = m.n(); var q = new R(1);
    items.stream().map(x -> x.y()).toList();
    return a && d ? 1 : 2; } }'''
    assert {r[0] for r in of("java", java, "const_ref")} == {"RED", "BLUE"}
    assert {(r[0], r[2]) for r in of("java", java, "assignment")} == {("a", "copy"), ("d", "field_access"), ("g", "call_result"), ("k", "method_call_result"), ("q", "constructor")}
    assert {(r[0], r[1], r[2]) for r in of("java", java, "accessor")} == {("isOk", "P", "boolean"), ("setOk", "P", "void"), ("getNames", "P", ""), ("setNames", "P", "void")}
    assert [(r[0], r[4]) for r in of("java", java, "chain")] == [("stream", "1"), ("map", "2"), ("toList", "3")]
    assert [(r[1], r[4]) for r in of("java", java, "lambda")] == [("map", "items.stream()")]
    assert sorted(r[0] for r in of("java", java, "decision")) == ["&&", "?", "case", "case"]
    assert [r[0] for r in of("python", "f = lambda x: x\nif a and b: pass\n", "lambda")] == ["f"]


def test_definition_files(spark):
    from skein.sources import definition_facts as D
    from skein.sources.definitions import lombok_accessors, path_aliases, storage_address

    rows = [
        ("p", "p/pom.xml", "<modules><module>core</module></modules> spring-boot mybatis"), ("p", "p/package.json", '{"workspaces": ["a/*"]}'), ("p", "p/m.xml", '<mapper namespace="u.M"><select id="one">SELECT * FROM t</select></mapper>'),
        ("p", "p/s.proto", "service S { rpc Get (A) returns (B); }"), ("p", "p/q.graphql", "type Query { user(id: ID): User }"), ("q", "q/tsconfig.json", '{"compilerOptions": {"baseUrl": "./src", "paths": {"@app/*": ["app/*"]}}} // x'), ("q", "q/a.java", "class A {}"), ("q", None, "x"),
    ]
    df = spark.createDataFrame([(s, p, c.encode(), 1) for s, p, c in rows], "source_project string, rel_path string, content binary, name int")
    facts = D.definition_facts(df)
    got = {(r.fact, r.name, r.detail) for r in facts.collect()}
    assert got >= {("module", "core", "pom.xml"), ("module", "a/*", "package.json"), ("mapper_query", "u.M.one", "SELECT SELECT * FROM t"), ("rpc", "Get", "S"), ("operation", "user", "Query"), ("path_alias", "@app/", "src/app"), ("framework", "spring", "route")}
    assert [tuple(r) for r in D.project_types(facts).collect()] == [("p", "maven", "package.json,pom.xml")]
    parsers = D.definition_parsers(D.project_frameworks(facts)).first()
    assert parsers.query_parser and not parsers.schema_parser and D.definition_facts(df.limit(0)).count() == 0
    assert path_aliases("{") == [] and path_aliases('{"compilerOptions": {"baseUrl": "lib",}}') == [("", "lib")]
    assert storage_address("kuzu") == "graph.db" and storage_address("kuzu", "", "c", "e") == "e" and storage_address("kuzu", "x", "c", "e") == "x"
    assert lombok_accessors(["Getter"], [("a", "int")]) == [("getA", "int", 0)]


def test_odd_texts(spark):
    for language in ("java", "go", "python", "typescript", "javascript"):
        for text in ("", "@", "@A(", "}}}{", "x.get(", "a = ", "'", "if {", "@A class", "select", ")" * 50, "f(" * 200):
            file_web_facts(language, text)
    df = spark.createDataFrame([("a.py", PY.encode(), 1), ("a.py", None, 1), (None, b"x", 1), ("b.txt", b"x", 1), ("c.go", b"", 1)], "rel_path string, content binary, line int")
    assert web_facts(df).where("fact = 'route'").count() == 5 and web_facts(df.limit(0)).count() == 0
