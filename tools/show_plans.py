"""Print the physical plans of the main stages (used to write PLANS.md)."""

import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from pyspark.sql import functions as F  # noqa: E402

from tessera.operators.prep import Preprocessor, drop_unlabelled  # noqa: E402
from tessera.operators.sampling import stratified_split  # noqa: E402
from tessera.session import local_session  # noqa: E402
from tessera.sources.adapter import SURVEY_ROLES as R, survey_view  # noqa: E402


def show(title, df):
    print(f"\n### {title}\n\n```")
    df.explain("simple")
    print("```")


def main():
    spark = local_session(8)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    lab = drop_unlabelled(survey_view(spark, sf), R.target)
    show("Survey scan: key and target only (pushed filter, pruned columns)", lab.select(R.key, R.target))
    split = stratified_split(lab, R.target, R.key)
    show("Stratified split: rows before the cut bucket need no shuffle; only the cut bucket is ranked", split)
    model = Preprocessor(R).fit(split.filter("split = 'train'"))
    show("Preparation transform: one narrow projection, statistics as literals", model.transform(split))
    from tessera.operators.knn import knn_join
    from tessera.sources.adapter import embedding_view
    emb = embedding_view(spark, sf).withColumnRenamed("vec_id", "id")
    show("kNN self-join (k=5): written inputs, explicit hash partitioning of (slab, ref chunk, query chunk) "
         "groups, cogrouped numpy blocks, window per query", knn_join(emb, emb, 5, exclude_self=True, block_rows=256))


if __name__ == "__main__":
    main()
