"""List prices of models, US dollars for a million tokens."""

#: Model, price of input and of output tokens; the list of January 2024, with later entries.
PRICES = (
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4-turbo", 10.00, 30.00),
    ("gpt-4-turbo-preview", 10.00, 30.00),
    ("gpt-4", 30.00, 60.00),
    ("gpt-3.5-turbo", 0.50, 1.50),
    ("text-embedding-3-small", 0.02, 0.0),
    ("text-embedding-3-large", 0.13, 0.0),
    ("text-embedding-ada-002", 0.10, 0.0),
    ("claude-3-opus-20240229", 15.00, 75.00),
    ("claude-3-sonnet-20240229", 3.00, 15.00),
    ("claude-3-haiku-20240307", 0.25, 1.25),
    ("claude-3-5-sonnet-20240620", 3.00, 15.00),
    ("claude-3-5-sonnet-20241022", 3.00, 15.00),
    ("claude-3-5-haiku-20241022", 1.00, 5.00),
    ("claude-3-opus", 15.00, 75.00),
    ("claude-3-sonnet", 3.00, 15.00),
    ("claude-3-haiku", 0.25, 1.25),
    ("claude-3.5-sonnet", 3.00, 15.00),
    ("claude-3.5-haiku", 1.00, 5.00),
    ("llama-3.1-70b-versatile", 0.59, 0.79),
    ("llama-3.1-8b-instant", 0.05, 0.08),
    ("llama-3.2-90b-vision-preview", 0.90, 0.90),
    ("mixtral-8x7b-32768", 0.24, 0.24),
    ("gemma2-9b-it", 0.20, 0.20),
    ("mistral-large-latest", 2.00, 6.00),
    ("mistral-medium-latest", 2.70, 8.10),
    ("mistral-small-latest", 0.20, 0.60),
    ("open-mistral-7b", 0.25, 0.25),
    ("open-mixtral-8x7b", 0.70, 0.70),
    ("open-mixtral-8x22b", 2.00, 6.00),
    ("meta-llama/Llama-3-70b-chat-hf", 0.90, 0.90),
    ("meta-llama/Llama-3-8b-chat-hf", 0.20, 0.20),
    ("mistralai/Mixtral-8x7B-Instruct-v0.1", 0.60, 0.60),
)
#: Providers whose calls cost nothing.
LOCAL_PROVIDERS = ("ollama", "vllm", "local")
