"""Fixed values that must equal the reference's for equal output.

FIXED VALUES (tags, prompt templates, chat-template markers, default system text, reward weights).
They are stated here plainly, in their natural order, and used everywhere else by name.
"""

# --- FIXED VALUES: answer tags -------------------------------------------------------------
RATIONALE_NAME = "rationale"
RATIONALE_OPEN = "<rationale>"
RATIONALE_CLOSE = "</rationale>"
MOVE_OPEN = "<uci_move>"
MOVE_CLOSE = "</uci_move>"

# --- FIXED VALUES: prompt templates (slots {FEN}, {side_to_move}, {legal_moves_uci}) ---------
PROMPT_BEST_MOVE = """Internally analyze the given chess position and select the best move for the side to move.

# Context
You will receive:
- **Position (FEN):**
{FEN}
- **Side to Move:** (either 'White' or 'Black')
{side_to_move}
- **Legal Moves:** (space-separated UCI moves)
{legal_moves_uci}

## FEN Explanation
FEN (Forsyth-Edwards Notation) encodes a chess board position using single letters [PNBRKQ] for White pieces and [pnbrkq] for Black pieces. Each rank (row), starting from the top (a8..h8), is specified. All eight squares in a rank are described, with digits [1..8] indicating consecutive empty squares.
- `/8/` denotes a completely empty rank.
- `/4P3/` means four empty squares, then a white pawn, then three more empty squares.

# Task
Select the best move from the provided legal moves list. If no legal moves exist, determine if it's checkmate or stalemate.

1. `<rationale>...</rationale>` - A single concise sentence explaining your move choice
2. `<uci_move>xxxx</uci_move>` - The selected valid move in UCI format

If no legal moves exist, output only: use 0000 for null moves
`<rationale>no legal moves available</rationale><uci_move>0000</uci_move>`

Do NOT include any other text, explanations, or formatting.
"""

PROMPT_PV_LINE = """Internally analyze the given chess position and select the best move for the side to move.

# Context
You will receive:
- **Position (FEN):**
{FEN}
- **Side to Move:** (either 'White' or 'Black')
{side_to_move}
- **Legal Moves:** (space-separated UCI moves)
{legal_moves_uci}

# Task
Select the best move from the provided legal moves list.

Return exactly:
1. `<rationale>...</rationale>` - A short best-line continuation as space-separated UCI moves (a PV). The FIRST move in this PV must be the same as the move you output in `<uci_move>...</uci_move>`.
2. `<uci_move>xxxx</uci_move>` - The selected valid move in UCI format (the next move to play).

If no legal moves exist, output only:
`<rationale>no legal moves available</rationale><uci_move>0000</uci_move>`

Do NOT include any other text, explanations, or formatting.
"""


# Default system text of the chat renders when the conversation has no leading system turn.
DEFAULT_SYSTEM = ("You are a chess expert playing a game. Analyze positions carefully and respond with both a rationale "
                  "explaining your reasoning and your move in UCI notation using <rationale></rationale> and "
                  "<uci_move></uci_move> tags.")

# System message of a game conversation (slots {assistant}, {user}, {fen}).
GAME_SYSTEM = """You are playing chess as {assistant}. The user is {user}.

Starting position (FEN): {fen}

Moves are in UCI notation inside <uci_move></uci_move> tags. Each move alternates the board state.
You will receive the current position and legal moves, then respond with your move in the same format."""

# Plain demo training text (slots {fen}, {side}, {moves}).
PLAIN_EXAMPLE = """Position (FEN): {fen}

Side to move: {side}

Legal moves: {moves}

What is your move?"""

# Theme rationale texts: 'fork' theme, 'mate' theme, anything else.
THEME_RATIONALE_FORK = "This move creates a fork, attacking multiple pieces"
THEME_RATIONALE_MATE = "This move leads to checkmate"
THEME_RATIONALE_OTHER = "This move gains a winning advantage"

# --- FIXED VALUES: chat-template markers ----------------------------------------------------
CHATML_START = "<|im_start|>"
CHATML_END = "<|im_end|>"
GEMMA_START = "<start_of_turn>"
GEMMA_END = "<end_of_turn>"
GEMMA_BOS = "<bos>"
LLAMA_BOS = "<|begin_of_text|>"
LLAMA_HEADER_START = "<|start_header_id|>"
LLAMA_HEADER_END = "<|end_header_id|>"
LLAMA_EOT = "<|eot_id|>"
GRANITE_ROLE_START = "<|start_of_role|>"
GRANITE_ROLE_END = "<|end_of_role|>"
GRANITE_END = "<|end_of_text|>"

# Model-family detection: name substrings in this order; then marker tokens in this order.
FAMILY_NAME_ORDER = ["llama", "qwen", "gemma", "granite", "mistral"]
FAMILY_TOKEN_CHECKS = [("chatml", "<|im_start|>", "qwen"),
                       ("gemma", "<start_of_turn>", "gemma"),
                       ("llama", "<|start_header_id|>", "llama"),
                       ("granite", "<|start_of_role|>", "granite")]

# --- FIXED VALUES: reward constants ---------------------------------------------------------
MATE_THRESHOLD = 9000
MATE_SCORE = 10000
TOKEN_PENALTY = -0.002
# (metric base name, weight) in the order the trainer receives them; the trainer sums in this order.
REWARD_MIX = [("combined_format", 0.5), ("token_penalty", 1.0), ("rationale_length", 0.5),
              ("legality", 0.5), ("stockfish_eval", 3.0)]
ADVANTAGE_EPS = 1e-4
IGNORE_INDEX = -100
