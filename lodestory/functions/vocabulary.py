"""Word lists and constants that define results.

Fixed values: the lists below must stay as they are, in this order, for right results.
"""

from __future__ import annotations

# Categories in order of precedence, with their keywords (substrings, lower case).
CATEGORY_KEYWORDS = {
    "model-releases": ["release", "launches", "launched", "introducing", "new model", "gpt-", "claude", "gemini", "llama", "mistral", "grok", "phi-", "qwen", "deepseek", "weights", "checkpoint", "fine-tun", "instruct", "chat model"],
    "research-papers": ["arxiv", "paper", "research", "study", "we propose", "we present", "benchmark", "dataset", "training", "preprint", "journal", "conference", "icml", "neurips", "iclr", "acl", "emnlp"],
    "company-news": ["funding", "raises", "acquisition", "acquires", "partnership", "valuation", "billion", "million", "ceo", "executive", "leadership", "series", "venture", "ipo", "layoffs", "hired"],
    "product-launches": ["api", "integration", "feature", "update", "plugin", "app", "tool", "platform", "service", "product", "available now", "generally available", "ga ", "beta", "preview", "copilot", "assistant", "chatbot"],
    "regulation-policy": ["regulation", "policy", "law", "congress", "senate", "eu ", "government", "act ", "ban", "safety", "alignment", "risk", "guidelines", "compliance", "gdpr", "executive order", "legislation"],
    "hardware-infrastructure": ["gpu", "tpu", "chip", "nvidia", "amd", "intel", "hardware", "compute", "data center", "inference", "h100", "h200", "blackwell", "cuda", "cluster", "supercomputer", "training infrastructure"],
    "open-source": ["open source", "open-source", "github", "release v", "v0.", "v1.", "v2.", "repo", "repository", "hugging face", "weights", "community", "apache", "mit license", "ollama", "llama.cpp", "vllm", "langchain"],
    "opinion-analysis": ["opinion", "analysis", "commentary", "editorial", "perspective", "why ", "how ", "what ", "should", "future of", "impact of", "the case for", "the case against", "reflections"],
}
UNCATEGORIZED = "uncategorized"
# Topic words (substrings) beside the whole word "ai".
RELEVANCE_KEYWORDS = ["artificial intelligence", "machine learning", "deep learning", "language model", "llm", "neural network", "neural net", "generative model", "foundation model", "chatgpt", "gpt-", "claude", "gemini", "llama", "mistral", "grok", "phi-", "qwen", "deepseek", "copilot", "dall-e", "midjourney", "stable diffusion", "sora", "glm-", "codex", "openai", "anthropic", "deepmind", "hugging face", "huggingface", "sakana", "sarvam", "fine-tun", "rlhf", "diffusion model", "embedding model", "chatbot", "deepfake"]
# The looser list for story items.
STORY_KEYWORDS = ["ai", "llm", "gpt", "claude", "gemini", "openai", "anthropic", "hugging", "transformer", "mistral", "llama", "deepseek", "neural", "diffusion", "machine learning", "deep learning", "language model", "inference"]
# Financial noise (substrings of a lower-case title).
NOISE_PATTERNS = ["stock", "stocks", "shares", "buy hand over fist", "investor", "portfolio", "etf", "nasdaq", "wall street", "earnings", "valuation", "market cap", "price target", "analyst", "bull case", "bear case", "to buy in", "top pick", "strong buy", "undervalued", "overvalued", "sell-off", "selloff", "worth a fortune", "getting cheaper", "could be worth", "motley fool", "the motley fool", "trillion in sales", "revenue forecast", "market share", "buy before", "before it", "don't miss", "missed out", "billionaire", "hedge fund"]
# Families by a word inside the collapsed name, first match wins.
FAMILIES = [("gpt", "GPT"), ("claude", "Claude"), ("gemini", "Gemini"), ("gemma", "Gemma"), ("llama", "Llama"), ("qwen", "Qwen"), ("mixtral", "Mistral"), ("mistral", "Mistral"), ("grok", "Grok"), ("deepseek", "DeepSeek"), ("phi", "Phi"), ("nemotron", "Nemotron"), ("command", "Command"), ("kimi", "Kimi"), ("falcon", "Falcon"), ("pixtral", "Pixtral"), ("nova", "Nova"), ("minimax", "MiniMax")]
# Fixed values: (file, display name, unit, score column).
BENCHMARK_FILES = [
    ("epoch_capabilities_index.csv", "Epoch Capabilities Index", "index", "ECI Score"),
    ("gpqa_diamond.csv", "GPQA Diamond", "%", "mean_score"),
    ("math_level_5.csv", "MATH Level 5", "%", "mean_score"),
    ("frontiermath.csv", "FrontierMath", "%", "mean_score"),
    ("swe_bench_verified.csv", "SWE-bench Verified", "%", "mean_score"),
    ("otis_mock_aime_2024_2025.csv", "AIME 2024/2025", "%", "mean_score"),
    ("simpleqa_verified.csv", "SimpleQA Verified", "%", "mean_score"),
    ("frontiermath_tier_4.csv", "FrontierMath Tier 4", "%", "mean_score"),
    ("hle_external.csv", "Humanity's Last Exam", "%", "Accuracy"),
    ("arc_agi_external.csv", "ARC-AGI", "%", "Score"),
    ("arc_agi_2_external.csv", "ARC-AGI-2", "%", "Score"),
    ("terminalbench_external.csv", "Terminal-Bench", "%", "Accuracy mean"),
    ("simplebench_external.csv", "SimpleBench", "%", "Score (AVG@5)"),
    ("weirdml_external.csv", "WeirdML", "%", "Accuracy"),
    ("apex_agents_external.csv", "APEX", "%", "Pass@1 score"),
    ("gso_external.csv", "GSO (code optimization)", "%", "Score OPT@1"),
    ("gdpval_external.csv", "GDPval (win/tie rate)", "%", "Win + tie rate (%)"),
    ("webdev_arena_external.csv", "WebDev Arena", "elo", "Arena Score"),
    ("metr_time_horizons_external.csv", "METR task horizon", "min", "Time horizon"),
]
# Evaluation fields, their benchmark and unit.
EVALUATIONS = [("gpqa", "GPQA Diamond", "%"), ("hle", "Humanity's Last Exam", "%"), ("aime_25", "AIME 2024/2025", "%"), ("tau2", "τ²-bench", "%"), ("livecodebench", "LiveCodeBench", "%"), ("scicode", "SciCode", "%"), ("mmlu_pro", "MMLU-Pro", "%")]
# Use-case buckets.
BUCKETS = {
    "coding": ["SWE-bench Verified", "Terminal-Bench", "GSO (code optimization)", "WebDev Arena", "LiveCodeBench", "SciCode"],
    "math": ["AIME 2024/2025", "MATH Level 5", "FrontierMath", "FrontierMath Tier 4"],
    "reasoning": ["GPQA Diamond", "Humanity's Last Exam", "SimpleQA Verified", "SimpleBench", "ARC-AGI", "ARC-AGI-2", "WeirdML", "MMLU-Pro"],
    "agentic": ["Terminal-Bench", "APEX", "METR task horizon", "GDPval (win/tie rate)", "τ²-bench"],
}
# Whole-query synonyms of search.
SYNONYMS = {
    "chatgpt": ["openai", "gpt"], "openai": ["gpt", "dall-e", "sora", "codex", "whisper"], "gpt": ["openai"], "anthropic": ["claude"], "claude": ["anthropic"],
    "google": ["gemini", "deepmind", "bard"], "gemini": ["google", "deepmind"], "deepmind": ["google", "gemini"], "meta": ["llama", "meta ai"], "llama": ["meta"],
    "mistral": ["mixtral"], "microsoft": ["copilot", "phi"], "copilot": ["microsoft", "github"], "apple": ["apple intelligence"], "nvidia": ["tensorrt", "cuda"],
    "huggingface": ["hugging face", "transformers"], "hugging face": ["huggingface"], "deepseek": ["deep seek"], "qwen": ["alibaba", "tongyi"], "alibaba": ["qwen", "tongyi"],
    "zhipu": ["glm", "chatglm", "z.ai"], "chatglm": ["zhipu", "glm"], "kimi": ["moonshot"], "moonshot": ["kimi"], "cohere": ["command-r", "command r"],
    "stability": ["stable diffusion", "sdxl", "stability ai"], "stable diffusion": ["stability", "sdxl"], "falcon": ["tii", "technology innovation institute"],
    "sakana": ["sakana ai"], "reka": ["reka ai", "reka flash"], "ai21": ["jamba", "ai21 labs"], "jamba": ["ai21", "ai21 labs"], "sarvam": ["sarvam ai"],
}
# First-party brands that sell under another name; service tiers; weak quantisations.
VENDOR_ALIASES = {"qwen": "alibaba"}
SERVICE_TIER = r"(?i)/(flex|priority|batch|off-?peak|turbo|high-?speed|fast)$"
LOW_QUANT = r"(?i)^(fp|int)[1-7]$"
UMBRELLA_PREFIX = "claude "
# Thresholds.
NEWS_THRESHOLD, PAPER_THRESHOLD = 0.30, 0.10
PAPER_PREFIX = "arXiv"
PRICE_EVENT_MIN, FLOOR_MATERIAL_PCT = 0.05, 15
FLOOR_CONTEXT_SHARE = 0.5
# What is cut from release notes, in this order, and what stands for it.
RELEASE_NOISE = [
    (r"```[\s\S]*?```", ""),
    (r"`[^`\n]+`", ""),
    (r"(?m)^\s*\*\s+[\w\s]+:.*$", ""),
    (r"(?m)^\s*[-*]\s+[a-f0-9]{7,}\b.*$", ""),
    (r"\n{3,}", "\n\n"),
    (r"^\s+|\s+$", ""),
]
