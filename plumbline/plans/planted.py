"""A deterministic test corpus: documents with a sentence or two of a fixed list after each text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNIPPETS = [
    "In today's digital world, let's delve into a game-changer. It is robust, dynamic, and transformative.",
    "As an AI language model, I cannot browse the internet. Certainly! I hope this helps. Let me know if you need more.",
    "Experts argue that the bridge stands as a testament to progress, highlighting its lasting significance. Studies show gains.",
    "The crew measured 14 spans in 1998, and Anna Weber kept the notes at https://example.org/notes for years.",
    "It's not just a tool, it's a journey. The museum boasts a rich cultural heritage and offers a vibrant tapestry.",
    "Everyone knows that research proves that it works. This matters more than ever — truly — and the future of work is here.",
    "We used roughly 20 sheets, perhaps one of the largest orders. Dr. Lee wrote 3.5 pages and went home.",
    "In order to utilize  the key, prior to lunch, read   on.\r\nDue to the fact that it rained, we stayed.\n\nA new paragraph.",
    "<!-- plumbline-disable-line --> When it comes to tea, it is much more than just a drink.\nAt its core, tea is simple.",
    "<!-- plumbline-disable WEASEL_INDUSTRY_REPORTS -->\nIndustry reports differ. <!-- plumbline-enable -->Industry reports agree.",
    "It marks a pivotal moment. It plays a crucial role. It plays a vital role. Moreover, it reflects its broader legacy.",
    "The tool reads the file. The tool reads the file. The tool reads the file again. Nothing else happens here today.",
    "<!-- plumbline-disable-next-line CLAIM_EVERYONE_KNOWS -->\nEveryone knows that it rains. Experts argue.\nEveryone knows that it snows. A plan, not a promise. Love, not war.",
    "<!-- plumbline-disable-file lexical_markers, BOGUS_NAME --> A robust, holistic paradigm: crucial, vital and seamless. Movement, development, and innovation. Research shows that it works (Lee et al).",
    "Whether you are a beginner or an expert, not only does it help but it also lasts. In this comprehensive guide, from soup to salad, the ever-evolving shop offers choice. In conclusion, why does it matter? Here's why: taste.",
    "It was part of a broader movement, leaving an indelible mark. Deeply rooted in tradition, it contributed to the wider understanding, setting the stage for more.",
    "It was featured in daily papers and various media outlets, with significant independent coverage. They maintain an active online presence. Local publications such as these agree. It is widely regarded as good, and many critics have argued.",
    "It has transformed the industry in an increasingly digital world, and is more relevant than ever before. Here is the revised version. [insert name] My training data goes up to then. The training data is old.\nSure, that helps.",
    "They are not just tools, they are friends. It is not a race but a walk. No gym here, no plan there, only will. It chose craft rather than speed. It represents a change. Not only that, but they also won. ```json",
    "A number of us endeavor to facilitate it. In the event that it rains, and subsequent to lunch, it has the ability to run at this point in time.",
    "The cornerstone ecosystem, landscape and realm of synergy: comprehensive, essential, integral, notable, paramount, significant and valuable. Empower, unleash, unlock, supercharge, revolutionize. Additionally, importantly, notably, ultimately, furthermore.",
    "Bolster, delving, elevate, fostering, garner, harnessing, illuminate, leverages, navigate, showcase, streamline, underscores. Enduring interplay, intricacies, intricate, meticulous, meticulously, multifaceted, nuanced.",
    "Is this a choice? So what does that mean? Sound familiar? What if I told you the answer is simple?",
]


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    # the tables are files of one row group, that is one task; tasks grow in number with the input, not in size
    docs = docs.repartition(max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()))
    extra = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int"))
    return docs.withColumn("text", F.concat("text", F.lit(" "), extra))


def q(text: str) -> str:
    """A string literal of DuckDB, with escapes for line ends."""
    body = text.replace("\\", "\\\\").replace("'", "\\'").replace("\r", "\\r").replace("\n", "\\n").replace("\t", "\\t")
    return f"E'{body}'"


PLANTED_SQL = f"planted AS MATERIALIZED (SELECT doc_id, lang, source, text || ' ' || [{', '.join(map(q, SNIPPETS))}][doc_id % {len(SNIPPETS)} + 1] AS text FROM documents)"
