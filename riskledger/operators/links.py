"""Relations between directories, and long lists cut into bounded parts."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskledger.catalog import names
from riskledger.functions import paths
from riskledger.operators.corpus import salted_join

LIST_PART = 1000


def list_parts(edges: DataFrame, keys, size: int | None = None) -> DataFrame:
    """``keys, parts``: into how many parts of about ``size`` items the list of each key is cut."""
    return edges.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(size or LIST_PART)).cast("int").alias("parts"))


def chunked_lists(edges: DataFrame, parts: DataFrame, keys, item: Column, spread: str) -> DataFrame:
    """``keys, part, items``: the sorted items of each key in its parts, numbered from 0.

    A key with few items gives one row.  A key with millions gives many, each built in its own group, so no
    group grows with the data and nothing is left out.
    """
    split = salted_join(edges, parts, list(keys), [spread]).withColumn("part", F.pmod(F.xxhash64(spread), F.col("parts")).cast("int"))
    return split.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(item)).alias("items"))


def with_list(rows: DataFrame, edges: DataFrame, keys, item: Column, spread: str, name: str) -> DataFrame:
    """``rows`` (one a key) with the list of their edges as ``name``, and ``part`` of ``parts``, from 0.

    A row is first repeated for each part of its list, then lists meet rows on key and part: no key gathers
    more than one list in a task.  A row without edges is part 0 of 1 with a null list.
    """
    parts = list_parts(edges, keys)
    lists = chunked_lists(edges, parts, keys, item, spread).withColumnRenamed("items", name)
    each = rows.join(parts, list(keys), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return each.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(lists, [*keys, "part"], "left")


def scope_markers(directory: Column) -> Column:
    found = [F.when(directory.contains(m), F.lit(m)) for m in names.SCOPE_MARKERS]
    return F.array_except(F.array(*found), F.array(F.lit(None).cast("string")))


@dataclass(frozen=True)
class ServerScopes:
    """Which servers an agent directory reaches, as two narrow tables that meet on a scope.

    ``directories``: ``scan_id, agent_dir, scope``, a few rows a directory.  ``servers``: ``scan_id, scope,
    server_name, first_path``, a few rows a server.  Both are linear in the directories and servers of a
    scan (times the depth of a path); every directory x server pair stands only in :meth:`pairs`.
    """

    directories: DataFrame
    servers: DataFrame

    def pairs(self, directories: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
        """``scan_id, agent_dir, server_name, first_path`` of all directories and servers, or of those in
        ``directories`` (``scan_id, agent_dir``) and ``names`` (``scan_id, server_name``) only."""
        asked, offered = self.directories, self.servers
        if directories is not None:
            asked = asked.join(directories.select("scan_id", "agent_dir").distinct(), ["scan_id", "agent_dir"], "left_semi")
        if names is not None:
            offered = salted_join(offered, names.select("scan_id", "server_name").distinct(), ["scan_id", "server_name"], ["scope"], "left_semi")
        return (salted_join(asked, offered, ["scan_id", "scope"], ["agent_dir"])
                .groupBy("scan_id", "agent_dir", "server_name").agg(F.min("first_path").alias("first_path")))


def _scope(kind: str, value) -> Column:
    return F.concat(F.lit(f"{kind} "), value)


def _servers(server_dirs: DataFrame) -> DataFrame:
    return server_dirs.groupBy("scan_id", "dir", "server_name").agg(F.min("path").alias("first_path"))


def _dirs(agent_dirs: DataFrame) -> DataFrame:
    return agent_dirs.select("scan_id", F.col("dir").alias("agent_dir")).distinct()


def _prefixed(rows: DataFrame, column: str, among: DataFrame, name: str) -> DataFrame:
    """``rows`` once for each string prefix of ``column`` that is one of ``among`` (``scan_id, <name>``)."""
    return salted_join(rows.withColumn(name, F.explode(paths.string_prefixes(F.col(column)))), among.select("scan_id", name).distinct(),
                       ["scan_id", name], [column], "left_semi")


def server_scopes(agent_dirs: DataFrame, server_dirs: DataFrame) -> ServerScopes:
    """Servers in reach of agent directories: either directory is a string prefix of the other, or both
    show the same tool marker.

    A directory answers to ``at d`` for each server directory ``d`` above it or equal, to ``below`` itself
    and to its markers; a server stands in its own directory, below each agent directory above it, and in
    its markers.  Servers are reduced to distinct names per scope.
    """
    agents, servers = _dirs(agent_dirs), _servers(server_dirs)
    homes = servers.select("scan_id", F.col("dir").alias("home")).distinct()
    marked = lambda rows, column: rows.withColumn(
        "scope", F.explode(F.transform(scope_markers(F.col(column)), lambda m: _scope("marker", m))))
    directories = (_prefixed(agents, "agent_dir", homes, "home").select("scan_id", "agent_dir", _scope("at", F.col("home")).alias("scope"))
                   .unionByName(agents.withColumn("scope", _scope("below", F.col("agent_dir"))))
                   .unionByName(marked(agents, "agent_dir")))
    below = _prefixed(homes, "home", agents, "agent_dir").where("home <> agent_dir").withColumnRenamed("home", "dir")
    offered = (servers.withColumn("scope", _scope("at", F.col("dir")))
               .unionByName(salted_join(servers, below, ["scan_id", "dir"], ["server_name"])
                            .select(*servers.columns, _scope("below", F.col("agent_dir")).alias("scope")))
               .unionByName(marked(servers, "dir")))
    return ServerScopes(directories, offered.groupBy("scan_id", "scope", "server_name").agg(F.min("first_path").alias("first_path")))


def reach_counts(agent_dirs: DataFrame, server_dirs: DataFrame) -> DataFrame:
    """``scan_id, agent_dir, servers``: how many server names each directory reaches, without its pairs.

    Of a name's directories only those count that have none of the same name above them.  Such a one lies
    either above an agent directory, where the counts of the directories on the way add up, or below it,
    where a name is counted once.  Names that a shared marker adds are counted for each set of markers, less
    those of them that the directory reaches anyway.
    """
    agents, servers = _dirs(agent_dirs), _servers(server_dirs).drop("first_path")
    homes = servers.select("scan_id", F.col("dir").alias("home")).distinct()
    above = _prefixed(homes.withColumn("dir", F.col("home")).drop("home"), "dir", homes, "home").where("home <> dir")
    lower = salted_join(servers, above, ["scan_id", "dir"], ["server_name"]).join(
        servers.withColumnRenamed("dir", "home"), ["scan_id", "home", "server_name"], "left_semi")
    top = servers.join(lower.select("scan_id", "dir", "server_name").distinct(), ["scan_id", "dir", "server_name"], "left_anti")

    marks = F.array_join(F.array_sort(scope_markers(F.col("agent_dir"))), "|")
    agents = agents.withColumn("marks", marks)
    offered = servers.withColumn("mark", F.explode(scope_markers(F.col("dir")))).select("scan_id", "mark", "server_name").distinct()
    sets = agents.where("marks <> ''").select("scan_id", "marks").distinct()
    named = (salted_join(offered, sets.withColumn("mark", F.explode(F.split("marks", r"\|"))), ["scan_id", "mark"], ["server_name"])
             .select("scan_id", "marks", "server_name").distinct())
    # marks '' stands for all names, other sets for the names that they add
    each = top.withColumn("marks", F.lit("")).unionByName(salted_join(top, named, ["scan_id", "server_name"], ["dir"]))
    sought = agents.select("scan_id", "agent_dir", "marks").unionByName(agents.withColumn("marks", F.lit(""))).distinct()

    at = each.groupBy("scan_id", "marks", F.col("dir").alias("home")).agg(F.count("*").alias("n"))
    ways = _prefixed(sought, "agent_dir", homes, "home")
    over = salted_join(ways, at, ["scan_id", "marks", "home"], ["agent_dir"]).groupBy("scan_id", "agent_dir", "marks").agg(F.sum("n").alias("n"))
    inside = _prefixed(homes, "home", agents, "agent_dir").where("home <> agent_dir").withColumnRenamed("home", "dir")
    under = (salted_join(each, inside, ["scan_id", "dir"], ["server_name"]).select("scan_id", "agent_dir", "marks", "server_name").distinct()
             .groupBy("scan_id", "agent_dir", "marks").agg(F.count("*").alias("n")))
    tree = over.unionByName(under).groupBy("scan_id", "agent_dir", "marks").agg(F.sum("n").alias("n"))
    total = named.groupBy("scan_id", "marks").agg(F.count("*").alias("n_marked"))
    plain = tree.where("marks = ''").select("scan_id", "agent_dir", F.col("n").alias("n_all"))
    out = agents.join(plain, ["scan_id", "agent_dir"], "left").join(tree.where("marks <> ''"), ["scan_id", "agent_dir", "marks"], "left")
    out = salted_join(out, total, ["scan_id", "marks"], ["agent_dir"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("scan_id", "agent_dir", (zero("n_all") + zero("n_marked") - zero("n")).alias("servers"))


def agents_below(container_dirs: DataFrame, agents: DataFrame) -> DataFrame:
    """Agents whose path starts with a container directory, as text: ``scan_id, dir`` + agent."""
    dirs = container_dirs.select("scan_id", "dir").distinct()
    return salted_join(agents.withColumn("dir", F.explode(paths.string_prefixes(F.col("path")))), dirs,
                       ["scan_id", "dir"], ["path"])


def nearest_repo(entries: DataFrame, repos: DataFrame) -> DataFrame:
    """Deepest repository directory enclosing each entry's ``dir``.

    ``repos``: ``scan_id, dir, remote, head``.  Adds ``repo_dir, remote, head, relative_path``.
    """
    r = repos.select("scan_id", F.col("dir").alias("repo_dir"), "remote", "head")
    dirs = entries.select("scan_id", "dir").distinct()
    hits = (salted_join(dirs.withColumn("repo_dir", F.explode(paths.ancestor_dirs(F.col("dir")))), r,
                        ["scan_id", "repo_dir"], ["dir"]).groupBy("scan_id", "dir")
            .agg(F.max_by(F.struct("repo_dir", "remote", "head"), F.length("repo_dir")).alias("m")))
    rel = F.when(F.col("dir") == F.col("m.repo_dir"), "").otherwise(
        paths.relative_to(F.col("dir"), F.col("m.repo_dir")))
    found = hits.select("scan_id", "dir", "m.repo_dir", "m.remote", "m.head", rel.alias("relative_path"))
    return salted_join(entries, found, ["scan_id", "dir"], ["path"] if "path" in entries.columns else ["dir"], "left")


